"""Order MinHash: fingerprints whose likeness follows edit distance.

The k-mers of a text (``K`` code points) are numbered by occurrence, so a repeated k-mer stands as often as it occurs. Each of
``SIGNATURES`` hash functions selects the ``ORDER`` k-mers of least hash; these, in the order in which they stand in the text, are
hashed to one value. Two texts agree in a value only if they share the selected k-mers and have them in the same order. The
likeness of two fingerprints is the share of equal values.

All code points of a text take part, in strips of bounded size. A text shorter than ``K`` is one k-mer; the empty
text has a fingerprint of its own, and its likeness to itself is 1. Null texts are empty texts. Equal texts have equal fingerprints.

:func:`with_next` sets every document beside the next one, in descending order of keys, through one shuffle of the texts: ranges of keys are
sorted inside tasks, and the first document of each range is also sent to the range before it (that of the first range to the last one).
Each range has a task of its own. Rows with equal keys stand in the order of their texts, null keys last; a key that fills several
ranges (as null may) is split among them, and its rows stand in the order of the texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel.llm.common import mix, start, tasks_for, texts

K = 6
SIGNATURES = 32
ORDER = 2
_STRIP = 16_384
_LEAST = -(2**63)  # where null keys stand
_FACTORS = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def numbered(text: str, k: int = K) -> np.ndarray:
    """A hash of every k-mer and its occurrence number, in text order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - k + 1
    with np.errstate(over="ignore"):
        if n < 1:
            n, k = min(1, len(code)), len(code)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[i : i + n]
        h = mix(h)
        if n > 1:
            bits = np.uint64(max(12, int(n).bit_length()))
            order = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
            at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            group = order >> bits
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            number = np.arange(n) - np.repeat(begin, np.diff(np.concatenate([begin, [n]])))
            again = number > 0
            if again.any():
                h[at[again]] = mix(h[at[again]] ^ mix(number[again].astype(np.uint64)))
    return h


def fingerprint(text: str, k: int = K, signatures: int = SIGNATURES, order: int = ORDER) -> np.ndarray:
    """One unsigned 32-bit value for each hash function."""
    h = numbered(text, k)
    if not len(h):
        return np.zeros(signatures, np.uint32)
    factor = _FACTORS[:signatures, None]
    least, place = np.zeros((signatures, 0), np.uint64), np.zeros((signatures, 0), np.int64)
    rows = np.arange(signatures)[:, None]
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), _STRIP):
            value = h[None, lo : lo + _STRIP] * factor
            chosen, at = [], []
            for _ in range(min(order, value.shape[1])):
                a = value.argmin(1)[:, None]
                chosen.append(value[rows, a])
                at.append(a + lo)
                value[rows, a] = np.iinfo(np.uint64).max
            least = np.concatenate([least, *chosen], axis=1)
            place = np.concatenate([place, *at], axis=1)
            if least.shape[1] > order:
                keep = np.argsort(least, axis=1, kind="stable")[:, :order]
                least, place = least[rows, keep], place[rows, keep]
        inner = np.argsort(place, axis=1, kind="stable")
        selected = h[place[rows, inner]]
        out = np.full(signatures, 1, np.uint64)
        for i in range(selected.shape[1]):
            out = mix(out * np.uint64(0x100000001B3) ^ selected[:, i])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexadecimal(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, part, last of all documents and of the extra copies (``last``) that close each range, each
    range whole in one task and sorted there."""
    start(docs.sparkSession)
    tasks = tasks_for(docs)
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    narrow = narrow.withColumn("rank", F.coalesce("key", F.lit(_LEAST)))
    # One bound per task at most; only ids are read for them.
    bounds = sorted(int(b) for b in narrow.approxQuantile("rank", [i / tasks for i in range(1, tasks)], 0.25 / tasks) or []) if tasks > 1 else []
    part, hashed = F.lit(0), F.lit(0).cast("long")
    if bounds:
        # Keys above the last bound are range 0, those up to the first one the last range. A key that is a bound several
        # times has as many ranges, by hashes of the texts.
        at_least = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("rank")))
        hot = {b: n for b, n in Counter(bounds).items() if n > 1}
        part = at_least
        if hot:
            shares = F.create_map(*[F.lit(x) for b, n in hot.items() for x in (b, n)])[F.col("rank")]
            hashed = F.when(shares.isNotNull(), F.shiftrightunsigned(F.xxhash64("text"), 33)).otherwise(0)
            part = F.coalesce(at_least - shares + 1 + F.shiftright(hashed * shares, 31), at_least)
    placed = narrow.withColumn("hashed", hashed).withColumn("part", part.cast("int"))
    # The first row of each range, found without the texts.
    heads = placed.groupBy("part").agg(F.min(F.struct(F.bitwise_not("rank").alias("below"), "hashed")).alias("head"))
    ahead = F.struct(F.bitwise_not("rank").alias("below"), "hashed")
    first = placed.join(F.broadcast(heads), "part").where(ahead == F.col("head")).groupBy("part").agg(F.min("text").alias("text"), F.first("key").alias("key"))
    by_part = Window.orderBy("part")
    ring = heads.select("part", F.coalesce(F.lag("part").over(by_part), F.max("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    closing = first.join(ring, "part").select("key", "text", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("hashed"), F.col("before").alias("part"), F.lit(True).alias("last"))
    rows = placed.withColumn("last", F.lit(False)).unionByName(closing)
    placed_rows = rows.repartitionById(tasks, "part").sortWithinPartitions("part", "last", F.col("rank").desc(), "hashed", "text")
    return placed_rows.select("key", "text", "part", "last")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its text with the last third replaced by the start of the next document, and likenesses."""
    rows = with_next(docs, key, text)
    schema = T._parse_datatype_string(
        f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # a document waits for the one after it
        for batch in batches:
            out = []
            keys, parts, last = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "part", "last"))
            for k, part, closes, t in zip(keys, parts, last, texts(batch, "text"), strict=True):
                f = fingerprint(t)
                if before is not None and before[0] == part:
                    out.append(edit(before, t, f))
                before = None if closes else (part, k, t, f)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def edit(before, following: str, f_next: np.ndarray) -> tuple:
        _, k, t, f = before
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        g = f if edited == t else fingerprint(edited)
        return k, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexadecimal(f), hexadecimal(g), likeness(f, g), likeness(f, f_next)

    return rows.mapInArrow(run, schema)

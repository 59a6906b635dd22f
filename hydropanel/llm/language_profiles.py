"""Language by rank-order profiles of n-grams.

A profile lists the most frequent letter n-grams (one to three characters, a space standing for the edges of words) by falling
frequency, equal ones by code points. A language's profile comes from the counts over all its training documents, added up in
the shuffle. A document's profile is compared with each language's by the out-of-place distance: the sum, over the document's n-grams, of
how far apart its two ranks are, an n-gram that the language lacks counting ``TOP``. The nearest language is predicted (equal distances: the
first by name).

The score is ``second / (nearest + second)``, 0.5 when two languages are as near, towards 1 when the nearest is far nearer; it is 1
where only one language is known.

Null texts and texts without a letter are ``und`` with score 0, and so are all texts if nothing was learned. Rows with a null language are
not learned from. Repeated rows count as often as they stand and are predicted alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel.llm.common import pieces, rowwise, start, texts

TOP = 400
NONE = "und"
_SHIFT = 21  # bits of a code point
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points stand in n-grams: letters and the marks on them."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)]))
    return _letters[0]


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, n-gram and its count in the row, sorted by row and n-gram. An n-gram is its code points, 21 bits each."""
    low = [" " + t.lower() + " " for t in rows]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows)), [len(t) for t in low])
    code = np.where(letters()[code], code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    present = np.zeros(0x110000, bool)
    present[code] = True
    alphabet = np.flatnonzero(present)
    dense = np.zeros(0x110000, np.int64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)
    width = int(len(alphabet) + 1).bit_length()
    c = dense[code]
    space = code == 32
    same1 = row[1:] == row[:-1]
    same2 = row[2:] == row[:-2]
    base = row.astype(np.int64) << (3 * width)
    one = (base | c)[~space]
    two = (base[1:] | (c[:-1] << width) | c[1:])[same1]
    three = (base[2:] | (c[:-2] << (2 * width)) | (c[1:-1] << width) | c[2:])[same2 & ~space[1:-1]]
    key = np.sort(np.concatenate([one, two, three]))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([begin, [len(key)]]))
    key = key[begin]
    points = np.concatenate([[0], alphabet])
    mask = (1 << width) - 1
    gram = (points[(key >> (2 * width)) & mask] << (2 * _SHIFT)) | (points[(key >> width) & mask] << _SHIFT) | points[key & mask]
    return key >> (3 * width), gram, count


def top(row: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's most frequent entries and their ranks; entries are sorted by row and n-gram."""
    order = np.argsort((row << 32) - count, kind="stable")
    r = row[order]
    begin = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
    rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(r)]])))
    return order[rank < most], rank[rank < most]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = TOP) -> DataFrame:
    """lang, gram, rank: the profiles of all languages."""
    start(docs.sparkSession)
    narrow = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("lang").isNotNull())
    schema = T._parse_datatype_string("lang string, gram long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for name, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], schema=arrow)
            held.clear()

        for batch in batches:
            names, rows = batch.column(0).to_pylist(), texts(batch, "text")
            for lo, hi in pieces([len(t) for t in rows]):
                row, gram, count = grams(rows[lo:hi])
                number = {x: k for k, x in enumerate(sorted(set(names[lo:hi])))}
                of = np.array([number[x] for x in names[lo:hi]])[row]
                for x, k in number.items():
                    g, n = held.get(x, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    g, n = np.concatenate([g, gram[of == k]]), np.concatenate([n, count[of == k]])
                    g, where = np.unique(g, return_inverse=True)
                    held[x] = g, np.bincount(where, weights=n, minlength=len(g)).astype(np.int64)
            if sum(len(g) for g, _ in held.values()) > 1_000_000:
                yield from flush()
        yield from flush()

    counts = narrow.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent of each language: an aggregate that keeps ``most`` entries, not a sort of them all.
    best = counts.groupBy("lang", F.pmod("gram", F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, most).alias("best"))
    whole = best.groupBy("lang").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, most).alias("best"))
    return whole.select("lang", F.posexplode("best").alias("rank", "b")).select("lang", F.col("b.gram").alias("gram"), "rank")


class Profiles:
    """The languages' profiles inside a task."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = TOP) -> None:
        self.most = most
        self.names = sorted({r[0] for r in rows})
        self.gram = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.names), len(self.gram) + 1), -1, np.int64)
        number = {x: k for k, x in enumerate(self.names)}
        for name, gram, rank in rows:
            self.rank[number[name], np.searchsorted(self.gram, gram)] = rank

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        name, score = [NONE] * len(rows), np.zeros(len(rows))
        if not self.names:
            return name, score
        for lo, hi in pieces([len(t) for t in rows]):
            row, gram, count = grams(rows[lo:hi])
            if not len(row):
                continue
            at, rank = top(row, count, self.most)
            row, gram = row[at], gram[at]
            place = np.searchsorted(self.gram, gram)
            place[(place == len(self.gram)) | (self.gram[np.minimum(place, len(self.gram) - 1)] != gram)] = len(self.gram)
            theirs = self.rank[:, place]
            apart = np.where(theirs < 0, self.most, np.abs(theirs - rank))
            distance = np.stack([np.bincount(row, weights=a, minlength=hi - lo) for a in apart])
            nearest = distance.argmin(0)
            ordered = np.sort(distance, axis=0)
            second = ordered[1] if len(self.names) > 1 else np.ones(hi - lo)
            first = ordered[0] if len(self.names) > 1 else np.zeros(hi - lo)
            sure = np.where(first + second > 0, second / np.maximum(first + second, 1e-9), 0.5)
            for r in np.unique(row).tolist():
                if any(c.isalpha() for c in rows[lo + r]):
                    name[lo + r], score[lo + r] = self.names[nearest[r]], sure[r]
        return name, score


def identify(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", most: int = TOP) -> DataFrame:
    """key, lang_pred and score of every document. The profiles sent to the tasks have ``most`` rows a language."""
    spark = start(docs.sparkSession)
    sent = spark.sparkContext.broadcast(Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], most))

    def run(batch) -> dict:
        name, score = sent.value.predict(texts(batch, text))
        return {"lang_pred": name, "score": score}

    return rowwise(docs, [key, text], run, "lang_pred string, score double", keep=[key])

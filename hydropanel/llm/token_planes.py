"""Token ids as compressed bit planes in chunks, with an index.

The output is one sequence: documents in ascending key order, each document's ids followed by the end id. It is cut into shards
(ranges of keys), a shard into chunks of whole documents with at least ``CHUNK`` ids, and a chunk into blocks of ``BLOCK`` ids (the
last one shorter). A block is transposed into bit planes, plane k holding bit k of every id, and each plane is compressed by
zstandard by itself; planes of high bits, which are nearly constant, shrink to almost nothing. A chunk is a row of a Parquet
table, so Spark writes and commits it on any store, and a task that is run again leaves no second copy. The chunk index gives
each chunk's first id in the whole sequence; with a chunk's own list of keys and sizes any document is found by reading one chunk.

Tokenizing works on parts between white space, which the tokenizer never joins: a part seen before is looked up, a new part
of plain characters goes to the merge model alone, any other part to the whole tokenizer. The ids equal those of the whole text.

Null and empty texts are documents with the end id alone. Rows with equal keys stand together in the order of their texts; null keys
come first. An empty table gives empty files.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel import session
from hydropanel.llm.common import raw_texts, start, tasks_for

BLOCK = 1 << 16
CHUNK = 1 << 18
LEVEL = 3
_KEEP_PARTS = 600_000
_TOGETHER = 4_000  # pieces coded in one call
_SHORT = 6

# Below U+0250 all characters are in composed form and lower-casing works character by character.
_LATIN = [chr(c) for c in range(33, 0x250) if not chr(c).isspace() and c != 127 and not 0x80 <= c < 0xA0]
_LETTERS = re.escape("".join(c for c in _LATIN if c.isalpha()))
_NUMBERS = "".join(c for c in _LATIN if c.isnumeric())
_VISIBLE = re.compile(f"[{re.escape(''.join(_LATIN))}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# The merge model reads bytes as visible characters: itself where there is one, else the next from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SELF} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SELF)}


class _Numbers(dict):
    """Numbers of parts in the order they were first asked for; ``fresh`` lists those not coded yet."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        self.fresh.append(part)
        number = self[part] = len(self)
        return number


class WordCodes:
    """Ids of the parts of texts under a word-level merge tokenizer, with a bounded memory of parts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._whole = path, None
        # The same merges for words that are cut and lowered already; a word's last id is one of ``ends``.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.merges.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.number, self.flat, self.bounds = _Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self):
        """The tokenizer with all its steps, loaded when the first part needs it."""
        from tokenizers import Tokenizer

        self._whole = self._whole or Tokenizer.from_file(self.path)
        return self._whole

    def forget(self) -> None:
        """Start over with the short parts, which come again most."""
        kept = [(p, n) for p, n in self.number.items() if len(p) <= _SHORT][: _KEEP_PARTS // 2]
        old = np.array([n for _, n in kept], np.int64)
        size = self.bounds[old + 1] - self.bounds[old]
        self.flat, self.bounds = self._gather(old), np.concatenate([[0], np.cumsum(size)])
        self.number = _Numbers()
        self.number.update((p, k) for k, (p, _) in enumerate(kept))

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these parts, one after the other."""
        size = self.bounds[numbers + 1] - self.bounds[numbers]
        stop = np.cumsum(size)
        return self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.bounds[numbers] - (stop - size), size)]

    def _learn(self) -> None:
        """Code the fresh parts together."""
        pieces: list[bytes] = []
        counts: list[int] = []
        other: dict[int, list[int]] = {}
        for part in self.number.fresh:
            if part.isalpha():  # plain letters
                pieces.append(part)
                counts.append(1)
            elif part[:-1].isalpha() and part[-1:] in _STOPS:
                pieces += (part[:-1], part[-1:])
                counts.append(2)
            elif _VISIBLE.fullmatch(text := part.decode()) and "<|" not in text:
                found = _PIECES.findall(text.lower())
                pieces += [p.encode() if p.isascii() else p.encode().decode("latin-1").translate(_BYTES).encode() for p in found]
                counts.append(len(found))
            else:
                other[len(counts)] = self.whole().encode(text, add_special_tokens=False).ids
                counts.append(0)
        coded = [np.zeros(0, np.uint32)]
        for k in range(0, len(pieces), _TOGETHER):
            some = b" ".join(pieces[k : k + _TOGETHER]).lower().decode()
            coded.append(np.array(self.merges.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(coded)
        piece_stop = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        stop = piece_stop[np.cumsum(counts)]
        if other:
            at = np.array(list(other))
            ids = np.insert(ids, np.repeat(stop[at], [len(x) for x in other.values()]), [i for x in other.values() for i in x]).astype(np.uint32)
            more = np.zeros(len(counts), np.int64)
            more[at] = [len(x) for x in other.values()]
            stop = stop + np.cumsum(more)
        self.bounds = np.concatenate([self.bounds, len(self.flat) + stop])
        self.flat = np.concatenate([self.flat, ids])
        self.number.fresh.clear()

    def encode(self, text: bytes) -> np.ndarray:
        """Numbers of a text's parts."""
        # Lower-casing plain letters first is what the tokenizer does anyway, except next to combining marks (which
        # compose before they are lowered) and inside the strings of special tokens.
        low = text.lower() if b"<|" not in text and not _MARKS.search(text) else text
        low = low.replace(b"\n", b" ")
        if not _ODD_STOP.search(low):  # stops and commas after letters are parts of their own
            low = low.replace(b". ", b" . ").replace(b", ", b" , ")
        parts = low.split(b" ")
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def documents(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        if len(self.number) > _KEEP_PARTS:
            self.forget()
        numbers = [self.encode(t) for t in texts]
        if self.number.fresh:
            self._learn()
        return [np.append(self._gather(n), np.uint32(end)) for n in numbers]


_STOPS = (b".", b",")
_ODD_STOP = re.compile(rb"[^a-z][.,] ")
# UTF-8 of characters from U+0300 on start with these bytes; combining marks are among them.
_MARKS = re.compile(rb"[\xcc-\xf4]")


def shuffle_bits(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest first, up to the highest bit in use; each compressed."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    return [squeeze(np.packbits(octets[k >> 3] & np.uint8(1 << (k & 7)))) for k in range(top)]


def unshuffle_bits(planes: list[bytes], count: int) -> np.ndarray:
    octets = np.zeros((4, count), np.uint8)
    open_ = zstandard.ZstdDecompressor().decompress
    for k, plane in enumerate(planes):
        octets[k >> 3] |= np.unpackbits(np.frombuffer(open_(plane), np.uint8), count=count) << np.uint8(k & 7)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


_CHUNK_ROW = "shard int, chunk int, first_in_shard long, n_ids long, keys array<long>, sizes array<long>, blocks array<array<binary>>"
_coders: dict[str, WordCodes] = {}


def coder(tokenizer: str) -> WordCodes:
    """One for all tasks of a Python worker. (A module's function is sent by name, so it sees the
    worker's own dictionary; a nested function would be sent with a copy.)"""
    if tokenizer not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _coders[tokenizer] = WordCodes(tokenizer)
    return _coders[tokenizer]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end: int = 1) -> str:
    """Write the ids of all documents; returns the folder, with the tables ``chunks`` and ``index``."""
    spark = start(docs.sparkSession)
    folder = folder or session.fresh_path(spark, "token-planes")
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = narrow.repartitionByRange(tasks_for(docs), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    schema = T._parse_datatype_string(_CHUNK_ROW)
    arrow = to_arrow_schema(schema)

    def run(batches):
        shard = TaskContext.get().partitionId()
        codes = coder(tokenizer)
        keys, held, chunk, first, waiting = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(held)
            blocks = [shuffle_bits(flat[k : k + BLOCK]) for k in range(0, len(flat), BLOCK)]
            values = [shard, chunk, first, len(flat), keys, [len(h) for h in held], blocks]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), codes.documents(raw_texts(batch, "text"), end), strict=True):
                keys.append(k)
                held.append(ids)
                waiting += len(ids)
                if waiting >= CHUNK:
                    yield row()
                    keys, held, chunk, first, waiting = [], [], chunk + 1, first + waiting, 0
        if keys:
            yield row()

    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/chunks")
    chunks = spark.read.schema(_CHUNK_ROW).parquet(f"{folder}/chunks").select("shard", "chunk", "first_in_shard", "n_ids", F.size("keys").alias("n_docs"))
    # One row per shard, of which there are as many as tasks.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.withColumn("offset", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("shard", "offset")
    index = chunks.join(offsets, "shard").select("shard", "chunk", (F.col("offset") + F.col("first_in_shard")).alias("first_id"), "n_ids", "n_docs")
    index.write.parquet(f"{folder}/index")
    return folder


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document, from the files."""
    start(spark)
    chunks = spark.read.schema(_CHUNK_ROW).parquet(f"{folder}/chunks")
    index = spark.read.schema("shard int, chunk int, first_id long").parquet(f"{folder}/index")
    schema = T._parse_datatype_string(f"`{key}` long, start long, ids binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left = sum(row["sizes"])
                flat = []
                for planes in row["blocks"]:
                    flat.append(unshuffle_bits(planes, min(BLOCK, left)))
                    left -= BLOCK
                raw = np.concatenate(flat).astype("<u4")
                stop = np.cumsum(row["sizes"])
                begin = stop - row["sizes"]
                # Views on one buffer: the ids of each document are not copied one by one.
                bounds = np.concatenate([[0], stop * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
                columns = [pa.array(row["keys"], pa.int64()), pa.array(begin + row["first_id"], pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    placed = chunks.join(index, ["shard", "chunk"]).select("first_id", "keys", "sizes", "blocks")
    return placed.mapInArrow(run, schema)

"""Training documents that contain benchmark items: BM25 over an index of the items, block-max WAND, overlap check.

The index holds test items, cut into segments of at most ``SEGMENT`` words. A segment's BM25 weights are divided by its own total,
so a passage with all of its words scores 1. A term's posting list has the segments in order, with exact weights and, for each run of
``BLOCK`` segments, the largest weight. Every window of ``2 * SEGMENT`` words of every document, a new one each ``SEGMENT`` words, is a
query, so each segment that a document holds lies inside one window. All windows of a batch move through the lists together, each with
a cursor for every term:

1. Pivot: cursors are sorted by segment and the largest weights still ahead of them are summed; the first segment at which the sum
   reaches the threshold is the pivot, as no earlier one can. A window without a pivot is done.
2. Block bound: the block maxima of the terms at or before the pivot must reach the threshold too. Otherwise these cursors skip to the
   end of the block, or to the next cursor if that comes first.
3. Cursors move to a pivot that passes and its exact score is summed; all segments at or above the threshold are kept, however many.
4. Verification: of the item's question (all but its last sentence) and of its answer (the last sentence), at least ``OVERLAP`` of the
   words must lie in ``GRAM``-word runs that the document shares near the window. A part of fewer words must stand there as a whole.

Equal items are indexed once and their ids joined back. Items are taken in slices of about ``SLICE_WORDS`` words, each with an index of
bounded size that is sent to the tasks; inverse frequencies and the mean length of a segment are those of all different items. Words are compared in lower case without punctuation.

Null and empty documents hold nothing; null and empty items are not looked for. Repeated documents each have their rows; repeated items
each are found. Rows with a null key are searched like others. Of equally good windows the first one of a document is returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel.llm.common import only_rows, start, texts

SEGMENT = 64
BLOCK = 4
TOGETHER = 2048
THRESHOLD = 0.5
GRAM = 3
OVERLAP = 0.6
SLICE_WORDS = 1_000_000
K1, B = 1.2, 0.75

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space separate them."""
    return text.lower().encode().translate(_PLAIN).split()


def parts(text: str) -> tuple[int, int]:
    """Number of words of the question and of the answer."""
    sentences = [n for n in (len(words(s)) for s in re.split(r"(?<=[.!?])\s+|\n", text)) if n]
    return sum(sentences[:-1]), (sentences[-1] if sentences else 0)


class Index:
    """A slice of the items: dictionary, posting lists with block maxima, shared runs."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[bytes, int], total: int, mean_words: float, threshold: float = THRESHOLD) -> None:
        self.ids, self.threshold = [i for i, _ in items], threshold
        split = [words(t) for _, t in items]
        self.parts = [parts(t) for _, t in items]
        vocabulary = sorted({w for s in split for w in s})
        self.term = {w: k for k, w in enumerate(vocabulary)}
        idf = np.array([math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in vocabulary])
        self.coded = [np.array([self.term[w] for w in s], np.int64) for s in split]
        weights, self.owner = [], []
        for i, code in enumerate(self.coded):
            pieces = max(1, -(-len(code) // SEGMENT))
            for piece in np.array_split(code, pieces):
                count = Counter(piece.tolist())
                raw = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(piece) / mean_words)) for t, n in count.items()}
                whole = sum(raw.values())
                weights.append({t: v / whole for t, v in raw.items()} if whole else {})
                self.owner.append(i)
        # segments of similar length share a block, so its maxima say more about each of them
        order = sorted(range(len(weights)), key=lambda k: (len(weights[k]), k))
        self.owner = [self.owner[k] for k in order]
        # every list ends with a segment behind all others, of weight 0
        self.end = len(order)
        posting: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for k, at in enumerate(order):
            for t, v in weights[at].items():
                posting[t].append((k, v))
        size = np.array([len(p) + 1 for p in posting], np.int64)
        self.first = np.cumsum(size) - size
        self.segment = np.array([k for p in posting for k, _ in [*p, (self.end, 0.0)]], np.int64)
        self.weight = np.array([v for p in posting for _, v in [*p, (self.end, 0.0)]])
        term = np.repeat(np.arange(len(vocabulary)), size)
        self.place = term * (self.end + 1) + self.segment
        self.ahead = self._largest_ahead(size)
        self.n_blocks = self.end // BLOCK + 1
        self.block, starts = np.unique(term * self.n_blocks + self.segment // BLOCK, return_index=True)
        self.block_max = np.maximum.reduceat(self.weight, starts) if len(starts) else self.weight

    def _largest_ahead(self, size: np.ndarray) -> np.ndarray:
        """The largest weight of a list from each posting on."""
        out = self.weight.copy()
        for lo, n in zip(self.first.tolist(), size.tolist(), strict=True):
            out[lo : lo + n] = np.maximum.accumulate(out[lo : lo + n][::-1])[::-1]
        return out

    def retrieve(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, segments and scores at or above the threshold, for rows of different terms padded with -1."""
        window = np.arange(len(term))
        least, width = self.threshold - 1e-9, term.shape[1]
        columns = np.arange(width)
        padded = term < 0
        term = np.where(padded, 0, term)
        # padding stands on the end of a list
        cursor = np.where(padded, np.append(self.first[1:], len(self.segment))[term] - 1, self.first[term])
        while len(window):
            # 1. pivot
            at = self.segment[cursor]
            ranked = np.sort(at * width + columns, axis=1)
            reach = np.cumsum(np.take_along_axis(self.ahead[cursor], ranked % width, axis=1), axis=1) >= least
            alive = reach[:, -1]
            if not alive.all():
                window, term, cursor, at, ranked, reach = window[alive], term[alive], cursor[alive], at[alive], ranked[alive], reach[alive]
                if not len(window):
                    return
            rows = np.arange(len(window))
            pivot = ranked[rows, reach.argmax(axis=1)] // width
            # 2. block maxima of the terms that have come to the pivot
            row, column = np.nonzero(at <= pivot[:, None])
            t = term[row, column]
            block = t * self.n_blocks + pivot[row] // BLOCK
            k = np.searchsorted(self.block, block)
            k[k == len(self.block)] = 0
            bound = np.bincount(row, weights=np.where(self.block[k] == block, self.block_max[k], 0.0), minlength=len(window))
            passed = bound >= least
            after = np.where(at > pivot[:, None], at, self.end).min(axis=1)
            ahead = np.where(passed, pivot + 1, np.minimum((pivot // BLOCK + 1) * BLOCK, after))
            # 3. exact scores of the pivots that passed
            exact = passed[row]
            r, s = row[exact], pivot[row[exact]]
            to = np.searchsorted(self.place, t[exact] * (self.end + 1) + s)
            score = np.bincount(r, weights=np.where(self.segment[to] == s, self.weight[to], 0.0), minlength=len(window))
            good = passed & (score >= least)
            if good.any():
                yield window[good], pivot[good], score[good]
            cursor[row, column] = np.searchsorted(self.place, t * (self.end + 1) + np.minimum(ahead[row], self.end))

    def runs(self, item: int) -> list[tuple[int, ...]]:
        code = self.coded[item].tolist()
        n = min(GRAM, len(code))
        return [tuple(code[k : k + n]) for k in range(len(code) - n + 1)]

    def overlap(self, item: int, near: list[int]) -> tuple[float, float]:
        """Share of the question's and of the answer's words in runs that ``near`` has too."""
        size = len(self.coded[item])
        n = min(GRAM, size)
        there = {tuple(near[k : k + n]) for k in range(len(near) - n + 1)}
        covered = np.zeros(size, bool)
        for k, run in enumerate(self.runs(item)):
            if run in there:
                covered[k : k + n] = True
        q, a = self.parts[item]
        for lo, length in ((0, q), (q, a)):  # a part shorter than a run counts by itself, whatever stands before it
            if 0 < length < n:
                part = tuple(self.coded[item][lo : lo + length].tolist())
                if any(tuple(near[k : k + length]) == part for k in range(len(near) - length + 1)):
                    covered[lo : lo + length] = True
        return (covered[:q].mean() if q else 1.0), (covered[q : q + a].mean() if a else 1.0)

    def search(self, docs: list[str]) -> list[tuple[int, int, int, float, float, float]]:
        """(document, item, first word of the window, score, question and answer overlap) of verified items; the
        best window of each document and item."""
        get = self.term.get
        coded = [np.array([get(w, -1) for w in words(t)], np.int64) for t in docs]
        size = np.array([len(c) for c in coded], np.int64)
        if not size.sum() or not self.end:
            return []
        windows = np.maximum(1, -(-size // SEGMENT))
        base = np.cumsum(windows) - windows
        flat = np.concatenate(coded)
        doc = np.repeat(np.arange(len(docs)), size)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        known = np.flatnonzero(flat >= 0)
        cell, term = pos[known] // SEGMENT, flat[known]
        own = base[doc[known]] + cell
        early = np.flatnonzero(cell > 0)  # a word also belongs to the window that began one step earlier
        n_terms = len(self.first)
        pair = np.unique(np.concatenate([own, own[early] - 1]) * n_terms + np.concatenate([term, term[early]]))
        window, term = pair // n_terms, pair % n_terms
        best: dict[tuple[int, int], tuple] = {}
        asked, begins, count = np.unique(window, return_index=True, return_counts=True)
        # windows with about as many terms go together, so little is padded
        by_size = np.argsort(count, kind="stable")
        for lo in range(0, len(asked), TOGETHER):
            mine = by_size[lo : lo + TOGETHER]
            rows = np.full((len(mine), int(count[mine].max())), -1, np.int64)
            r = np.repeat(np.arange(len(mine)), count[mine])
            c = np.arange(len(r)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
            rows[r, c] = term[np.repeat(begins[mine], count[mine]) + c]
            for hit, segment, score in self.retrieve(rows):
                for w, s, v in zip(asked[mine[hit]].tolist(), segment.tolist(), score.tolist(), strict=True):
                    d = int(np.searchsorted(base, w, side="right") - 1)
                    item, from_word = self.owner[s], (w - int(base[d])) * SEGMENT
                    # 4. question and answer, around the window
                    reach = len(self.coded[item])
                    near = coded[d][max(0, from_word - reach) : from_word + 2 * SEGMENT + reach].tolist()
                    q, a = self.overlap(item, near)
                    if q >= OVERLAP and a >= OVERLAP:
                        found = (v, q, a, -from_word)
                        if found > best.get((d, item), (-1.0,)):
                            best[d, item] = found
        return [(d, item, -f[3], f[0], f[1], f[2]) for (d, item), f in sorted(best.items())]


def _texts(items: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The digest ``id`` of every item that has a text, with the text and the columns ``keep``."""
    whole = F.col(f"`{text}`")
    return items.where(F.trim(whole) != "").select(F.sha2(whole, 256).alias("id"), whole.alias("text"), *keep)


def indexes(items: DataFrame, text: str = "text", threshold: float = THRESHOLD, slice_words: int = SLICE_WORDS) -> Iterator[Index]:
    """The index in slices of bounded size; its ids are digests of the items' texts."""
    start(items.sparkSession)
    rows = _texts(items, text).dropDuplicates(["id"])
    by_word = T._parse_datatype_string("word binary, n int")
    arrow = to_arrow_schema(by_word)

    def split(batches):
        for batch in batches:
            pairs = [(w, 1) for t in texts(batch, "text") for w in set(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int32())], schema=arrow)

    def measure(batches):
        for batch in batches:
            sizes = [len(words(t)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array([max(1, -(-n // SEGMENT)) for n in sizes], pa.int64())], names=["n", "segments"])

    total, n_words, segments = rows.select("text").mapInArrow(measure, "n long, segments long").agg(F.count("*"), F.sum("n"), F.sum("segments")).first()
    if not total:
        return
    slices = max(1, math.ceil(n_words / slice_words))
    mean_words = max(1.0, n_words / segments)
    frequency = rows.select("text").mapInArrow(split, by_word).groupBy("word").agg(F.sum("n").alias("n"))
    placed = rows.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(slices)))
    for number in range(slices):
        own = placed.where(F.col("slice") == number).select("id", "text")
        mine = own.select("text").mapInArrow(split, by_word).select("word").distinct()
        known = {bytes(r["word"]): r["n"] for r in frequency.join(mine, "word").collect()}
        yield Index(sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda x: (str(x[0]), x[1])), known, total, mean_words, threshold)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it contains: key, item, from_word, bm25, question and answer overlap."""
    spark = start(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("item", T.StringType()), *T._parse_datatype_string("from_word long, bm25 double, question double, answer double")])
    arrow = to_arrow_schema(schema)
    out = None
    for index in indexes(items, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                hits = sent.value.search(texts(batch, "text"))
                keys, ids = batch.column(0).to_pylist(), sent.value.ids
                columns = [[keys[h[0]] for h in hits], [ids[h[1]] for h in hits], *[[h[k] for h in hits] for k in range(2, 6)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        one = narrow.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    out = spark.createDataFrame([], schema) if out is None else out
    # every item with the text that was found
    ids = _texts(items, item_text, F.col(f"`{item_key}`").alias("_item")).drop("text")
    out = out.join(ids, out["item"] == ids["id"]).select("key", F.col("_item").alias("item"), "from_word", "bm25", "question", "answer")
    return out.withColumnsRenamed({"key": key, "item": item_key} if key != item_key else {"key": key})


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, unchanged."""
    spark = start(docs.sparkSession)
    for index in indexes(items, item_text):
        sent = spark.sparkContext.broadcast(index)

        def free(batch, sent=sent) -> np.ndarray:
            mask = np.ones(batch.num_rows, bool)
            mask[[h[0] for h in sent.value.search(texts(batch, text))]] = False
            return mask

        docs = only_rows(docs, [text], free)
    return docs

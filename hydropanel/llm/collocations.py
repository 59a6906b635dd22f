"""Phrases that stand together more often than their parts, counted by sorting suffix pointers.

A suffix pointer is a place of a word in a piece (a stretch between punctuation marks and line breaks); its key is the word there and the following ones,
``longest`` at most. A map task combines equal suffixes of a chunk of text and sends each, with its count, to the bucket of its two leading
words, so that all occurrences of a phrase meet in one task; words by themselves are counted beside. A pair with more different suffixes in a chunk than
a bucket's share is split: its suffixes go by all their words, and only its count goes to the pair's own bucket, which then hands on
what it has of the pair as partial counts to be added. So no task gets much more than its share, however frequent a word, pair or passage is.

A task sorts the pointers of its bucket by multikey three-way quicksort, all open partitions at a time: each partition is split around a
pivot word into less, equal and greater; an equal partition goes on to the next word, and its size is the count of the phrase so far.
Partitions with fewer than ``least`` occurrences are abandoned at once, as no phrase in them can reach it; a part of a phrase is as
frequent as the phrase, so nothing that a score needs is lost. A bucket gets about ``BUCKET`` bytes of text, so memory stays
the same for any corpus.

For each cut of a candidate into two, the counts of both parts are joined on; the score of the cut is ``SCALE`` * a * a / (l * r), floored, in
decimals of 38 digits, which is exact for counts below 10^15.

Words are what stands between spaces and tabs, with A-Z lower-cased. A null text is empty, a null language is ``und``. Repeated
rows count as often as they occur. Equal scores of cuts go to the first cut; equally scored phrases are ranked by count, then by phrase. An empty
table gives no phrases. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.llm.common import mix, staged, start, tasks_for

LEAST = 10
LONGEST = 3
SCALE = 1_000_000
TOP = 2000
CHUNK = 1_000_000  # words of one chunk of a map task
SLAB = 1 << 20  # bytes of a text that are split at once
BUCKET = 16 << 20  # bytes of text for one sorting task
_BREAK = b"\xff"  # no byte of UTF-8
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_SALTS = 32
_FEW = 100  # suffixes that a pair may have in a chunk without being split
_WORD, _SUFFIX, _SPLIT, _MARK = range(4)


def stretches(text: bytes, longest: int, slab: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in stretches of about ``slab`` bytes, with a break after each piece, and how many of them begin phrases here:
    the last words of a stretch begin their phrases in the next one."""
    text = text.lower().translate(_MARKS)
    at, carried = 0, []
    while True:
        cut = text.find(b" ", at + slab) if len(text) - at > slab else -1
        words = carried + text[at : cut if cut >= 0 else len(text)].replace(_BREAK, b" \xff ").split()
        if cut < 0:
            yield [*words, _BREAK], len(words)
            return
        begin = max(0, len(words) - longest + 1)
        yield [*words, _BREAK], begin
        at, carried = cut, words[begin:]


def _equal(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns of numbers, sorted, and how often each occurs."""
    widths = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    if sum(widths) <= 63:
        key = columns[0].astype(np.int64)
        for c, w in zip(columns[1:], widths[1:], strict=True):
            key <<= w
            key |= c
        key.sort()
        at = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        number = np.diff(np.append(at, len(key)))
        key, out = key[at], []
        for w in widths[:0:-1]:
            out.append((key & ((1 << w) - 1)).astype(np.int32))
            key >>= w
        return [key.astype(np.int32), *out[::-1]], number
    order = np.lexsort(columns[::-1])
    columns = [c[order].astype(np.int32) for c in columns]
    at = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


class _Chunk:
    """Words of several texts under numbers of their own; 0 is a break."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[_BREAK]
        self.langs: defaultdict[str, int] = defaultdict(count().__next__)
        self.words: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes], begin: int, lang: str) -> None:
        self.begins.append(np.arange(len(words)) < begin)
        self.words.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.lang.append(np.full(len(words), self.langs[lang], np.int32))
        self.size += len(words)

    def _entries(self) -> list[tuple[int, list[np.ndarray], np.ndarray]]:
        """(kind, columns language and words, counts): what the chunk sends."""
        words, lang = np.concatenate(self.words), np.concatenate(self.lang)
        begins = np.concatenate(self.begins) & (words > 0)
        single, number = _equal([lang[begins], words[begins]])
        fill = [np.zeros(len(number), np.int32)] * (self.longest - 1)
        out = [(_WORD, [*single, *fill], number)]
        if self.longest > 1:
            after = np.append(words[1:], 0)
            at = np.flatnonzero(begins & (after > 0))
            columns = [lang[at], words[at], after[at]]
            for i in range(2, self.longest):
                later = np.append(words, np.zeros(i, np.int32))[at + i]
                columns.append(np.where(columns[-1] > 0, later, 0))
            suffix, number = _equal(columns)
            # Pairs with many different suffixes.
            first = np.flatnonzero(np.append(len(number) > 0, np.any([c[1:] != c[:-1] for c in suffix[:3]], axis=0))) if len(number) else np.zeros(0, np.int64)
            followers = np.diff(np.append(first, len(number)))
            heavy = followers > max(_FEW, len(number) // self.buckets)
            split = np.repeat(heavy, followers)
            out.append((_SUFFIX, [c[~split] for c in suffix], number[~split]))
            if heavy.any():
                out.append((_SPLIT, [c[split] for c in suffix], number[split]))
                marks = [c[first[heavy]] for c in suffix[:3]]
                out.append((_MARK, [*marks, *[np.zeros(len(marks[0]), np.int32)] * (self.longest - 2)], np.add.reduceat(number, first)[heavy]))
        return out

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed entries) of all buckets that get some."""
        spelled, langs = list(self.numbers), list(self.langs)
        digest = np.array([xxhash.xxh64_intdigest(w) for w in spelled], np.uint64)
        lang_digest = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in langs], np.uint64)
        routes, kinds, rows, numbers = [], [], [], []
        for kind, columns, number in self._entries():
            route = lang_digest[columns[0]]
            with np.errstate(over="ignore"):
                for c in columns[1 : {_WORD: 2, _SPLIT: None}.get(kind, 3)]:
                    route = mix(route * np.uint64(3) + digest[c])
            routes.append((route % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 1 << 16 else np.int64))
            kinds.append(np.full(len(number), kind, np.int8))
            rows.append(columns)
            numbers.append(number)
        route, kind, number = np.concatenate(routes), np.concatenate(kinds), np.concatenate(numbers)
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        order = np.argsort(route, kind="stable")
        route, kind, number, columns = route[order], kind[order], number[order], [c[order] for c in columns]
        edge = np.flatnonzero(np.append(len(route) > 0, route[1:] != route[:-1])) if len(route) else []
        dictionary = np.array(spelled, object)
        for lo, hi in zip(edge, np.append(edge[1:], len(route)) if len(route) else [], strict=True):
            yield int(route[lo]), _pack(kind[lo:hi], langs, [c[lo:hi] for c in columns], dictionary, number[lo:hi])
        self.clear()


def _planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, lowest first, as many as the largest number needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    wide = np.zeros((n, 4 if len(planes) <= 4 else 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return wide.view("<u4" if wide.shape[1] == 4 else "<u8").ravel()


def _pack(kind: np.ndarray, langs: list[str], columns: list[np.ndarray], spelled: np.ndarray, number: np.ndarray) -> bytes:
    """Entries with the words they use, compressed. The filling 0 of a short entry stays 0."""
    used = np.zeros(len(spelled), bool)
    used[0] = True
    for c in columns[1:]:
        used[c] = True
    code = np.cumsum(used) - 1
    first = np.diff(code[columns[1]], prepend=0) + len(code)  # sorted, so the steps are small
    parts = [b" ".join(spelled[used].tolist()), _planes(kind), _planes(columns[0]), _planes(first), *[_planes(code[c]) for c in columns[2:]], _planes(number)]
    batch = pa.record_batch([pa.array([[x.encode() for x in langs]], pa.list_(pa.binary())), pa.array([parts], pa.list_(pa.binary())), pa.array([[len(code), len(number)]])], names=["langs", "parts", "sizes"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpack(raw: bytes) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    """Languages, words, and as arrays: kinds, languages, words by column, counts."""
    row = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_next_batch().to_pylist()[0]
    offset, n = row["sizes"]
    words, *parts = row["parts"]
    arrays = [_from_planes(p, n) for p in parts]
    arrays[2] = np.cumsum(arrays[2].astype(np.int64) - offset)
    return row["langs"], words.split(b" "), arrays


def multikey_counts(columns: list[np.ndarray], weight: np.ndarray, least: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of rows that agree in their leading columns, ``first`` of them or more, and have a total weight of at least ``least``: a
    pointer into each, its weight, and in how many columns it agrees.

    All open partitions are split together: a round parts the pointers of each into those less than, equal to and greater than its pivot.
    """
    depth, n = len(columns), len(weight)
    word_at = np.concatenate(columns)
    pointers = np.arange(n)
    size, level = np.array([n]), np.zeros(1, np.int64)
    if int(weight.sum()) < least:
        pointers, size, level = pointers[:0], size[:0], level[:0]
    found, total, agree = [pointers[:0]], [pointers[:0]], [pointers[:0]]
    while len(size):
        stop = np.cumsum(size)
        part = np.repeat(np.arange(len(size), dtype=np.int32), size)
        word = word_at[(level * n)[part] + pointers]
        pivot = word[stop - size + size // 2][part]  # the middle pointer's word
        number = weight[pointers]
        rest, sizes, levels = [], [], []
        for side, deeper in ((word < pivot, 0), (word == pivot, 1), (word > pivot, 0)):
            where = np.flatnonzero(side)
            of = part[where]
            heavy = np.bincount(of, weights=number[where], minlength=len(size))
            open_ = heavy >= least
            keep = open_[of]
            own, length, next_level = pointers[where[keep]], np.bincount(of[keep], minlength=len(size))[open_], level[open_] + deeper
            if deeper:
                told = next_level >= first
                found.append(own[(np.cumsum(length) - length)[told]])
                total.append(heavy[open_][told].astype(np.int64))
                agree.append(next_level[told])
                more = next_level < depth
                if not more.all():
                    own, length, next_level = own[np.repeat(more, length)], length[more], next_level[more]
            rest.append(own)
            sizes.append(length)
            levels.append(next_level)
        pointers, size, level = np.concatenate(rest), np.concatenate(sizes), np.concatenate(levels)
    return np.concatenate(found), np.concatenate(total), np.concatenate(agree)


class _Bucket:
    """Entries of one bucket, under numbers of their own."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[_BREAK]
        self.langs: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.kind: list[np.ndarray] = []
        self.columns: list[list[np.ndarray]] = [[] for _ in range(longest + 1)]
        self.number: list[np.ndarray] = []

    def add(self, raw: bytes) -> None:
        langs, words, (kind, lang, *columns, number) = _unpack(raw)
        own = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        own_lang = np.fromiter(map(self.langs.__getitem__, langs), np.int32, len(langs))
        self.kind.append(kind.astype(np.int8))
        self.number.append(number.astype(np.int32))
        self.columns[0].append(own_lang[lang])
        for to, c in zip(self.columns[1:], columns, strict=True):
            to.append(own[c])

    def counts(self, least: int) -> Iterator[tuple[str, list[str], int, bool]]:
        """(language, phrase, count, whether it is partial); for each language the number of words with an empty phrase."""
        kind, number = np.concatenate(self.kind), np.concatenate(self.number)
        columns = [np.concatenate(c) for c in self.columns]
        self.kind, self.number, self.columns = [], [], []
        spelled, langs = list(self.numbers), [x.decode() for x in self.langs]

        def told(rows: np.ndarray, enough: int, first: int, partial: bool) -> Iterator[tuple[str, list[str], int, bool]]:
            some = [c[rows] for c in columns[: 2 if first == 2 else None]]
            at, total, agree = multikey_counts(some, number[rows], enough, first)
            for i, a, d in zip(at.tolist(), total.tolist(), agree.tolist(), strict=True):
                if some[d - 1][i]:  # else the suffix ends before
                    yield langs[some[0][i]], [spelled[c[i]].decode() for c in some[1:d]], a, partial

        word = np.flatnonzero(kind == _WORD)
        for name, n in zip(langs, np.bincount(columns[0][word], weights=number[word], minlength=len(langs)).tolist(), strict=True):
            yield name, [], int(n), False
        yield from told(word, least, 2, False)
        if self.longest < 2:
            return
        suffix, mark = (kind == _SUFFIX) | (kind == _MARK), np.flatnonzero(kind == _MARK)
        if len(mark):
            # A pair that is split somewhere: its count is complete here, the counts of longer phrases are not.
            pair = (columns[0].astype(np.int64) << 31 | columns[1]) * len(spelled) + columns[2]
            parted = suffix & np.isin(pair, pair[mark])
            yield from ((lang, phrase, a, False) for lang, phrase, a, _ in told(np.flatnonzero(parted), least, 3, False) if len(phrase) == 2)
            suffix &= ~parted
            rows = np.flatnonzero(parted & (kind == _SUFFIX))
            yield from told(rows, 1, 4, True)
        if self.longest > 2:
            yield from told(np.flatnonzero(kind == _SPLIT), 1, 4, True)
        yield from told(np.flatnonzero(suffix), least, 3, False)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int | None = None, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """lang, phrase (array of words), a: all phrases of up to ``longest`` words with at least ``least`` occurrences; and with an empty
    phrase, in several rows, the numbers of all word occurrences."""
    spark = start(docs.sparkSession)
    narrow = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    if buckets is None:
        size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(tasks_for(docs), size // BUCKET + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _Chunk(longest, buckets)

        def packed() -> Iterator[pa.RecordBatch]:
            for bucket, raw in some.flush():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([raw], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            where = {n: batch.column(batch.schema.get_field_index(n)) for n in ("text", "lang")}
            langs = where["lang"].to_pylist()
            for k, t in enumerate(where["text"].cast(pa.binary())):
                for words, begin in stretches(t.as_py() or b"", longest, slab):
                    some.add(words, begin, langs[k])
                    if some.size >= chunk:
                        yield from packed()
        if some.size:
            yield from packed()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Bucket(longest)
        for batch in batches:
            for raw in batch.column(1):
                own.add(raw.as_py())
        rows = own.counts(least) if own.kind else iter(())
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()), strict=True)], names=["lang", "phrase", "a", "partial"])

    routed = narrow.mapInArrow(send, "bucket int, packed binary").repartitionById(buckets, "bucket")
    found = staged(routed.mapInArrow(sort, "lang string, phrase array<string>, a long, partial boolean"), "phrases")
    added = found.where("partial").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("not partial").select("lang", "phrase", "a").unionByName(added)


def _part(phrase: Column, lo, size) -> Column:
    return F.array_join(F.slice(phrase, lo, size), " ")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = 50, buckets: int | None = None,
    chunk: int = CHUNK, slab: int = SLAB,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to ``longest`` words.

    A phrase inside a longer one that has at least ``inside`` percent of its occurrences is left out.
    """
    return rank(phrase_counts(docs, text, lang, least, longest, buckets, chunk, slab), top, inside)


def rank(counted: DataFrame, top: int = TOP, inside: int = 50) -> DataFrame:
    """The same from a table of :func:`phrase_counts`."""
    words_in = counted.where(F.size("phrase") == 0).groupBy("lang").agg(F.sum("a").alias("n"))
    known = counted.where(F.size("phrase") > 0).select("lang", F.array_join("phrase", " ").alias("words"), F.col("a").alias("number"))
    candidates = counted.where(F.size("phrase") > 1)
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _part(F.col("phrase"), F.col("k") + 1, F.size("phrase")).alias("right")
    )
    left = known.withColumnsRenamed({"words": "left", "number": "l"})
    right = known.withColumnsRenamed({"words": "right", "number": "r"})
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.expr(f"CAST({SCALE} AS DECIMAL(8,0)) * exact_a * exact_a div (exact_l * exact_r)")
    scored = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .withColumns({f"exact_{c}": e for c, e in exact.items()})
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    sizes = F.sequence(F.lit(2), F.size("phrase") - 1)
    within = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("phrase") - m + 1), lambda i: F.slice("phrase", i, m))))
    longer = candidates.where(F.size("phrase") > 2).select("lang", F.explode(within).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True)))
    flat = kept.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # Ranks within shares of a language first, so that no task sorts a whole language.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*best)
    few = flat.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words_in, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""SimHash fingerprints and the groups of documents whose fingerprints nearly agree.

A fingerprint has a bit for every bit position that is set in over half of the hashes of the word
shingles. Fingerprints are reduced to the distinct ones, each with its smallest document, so copies cost
nothing further. Candidate pairs are compared exactly, tile against tile, by exclusive-or and bit counts.

Two fingerprints with at most ``radius`` differing bits agree in at least two of ``radius + 2`` equal
blocks of bits, so every pair meets in the bucket of two agreeing blocks (six buckets each for radius 2,
keys of 32 bits). A bucket's fingerprints are dealt by population count and, where there are many, by a hash into tiles
of about ``tile`` rows. A pair of tiles is a task of its own unless the population counts differ by more than the radius,
so a crowded bucket means more tasks, not larger ones. A task returns a forest of its links, never all pairs.

Groups are connected components, found by rounds of smallest-neighbour propagation with pointer jumping on the distinct
fingerprints; each round is written to the shared folder.

Empty and null texts have fingerprint zero and are linked like any other. Repeated rows are separate documents with the
same fingerprint. Rows with a null key are fingerprinted and grouped; a group of null keys only has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.llm.common import fresh_name, raw_texts, rowwise, staged, start, tasks_for

BITS = 64
TILE = 2048
_PART = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of a UTF-8 text: A-Z lower-cased, words between ASCII white space, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):  # a very long text in parts
        part = words[at : at + _PART + shingle - 1] if n > 1 else words
        runs = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        h = np.array([digest(r, seed) for r in runs], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every document."""
    start(docs.sparkSession)

    def run(batch) -> dict:
        fp = np.array([fingerprint(t, shingle) for t in raw_texts(batch, text)], dtype=np.uint64)
        return {"fp": fp.view(np.int64)}

    return rowwise(docs, [key, text], run, "fp long", keep=[key])


def _links(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, between a and b or (b None) inside a, in strips of bounded size."""
    other = a if b is None else b
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        yield i, j


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            open_ = low != high
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(root, high[open_], low[open_])
            while (root != root[root]).any():
                root = root[root]
    return root


def _compare(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of one tile pair (side 0 and side 1), as edges of a forest."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(right):
        pairs = ((left[i], right[j]) for i, j in _links(fp[left], fp[right], radius))
    else:
        pairs = ((left[i], left[j]) for i, j in _links(fp[left], None, radius))
    root = _forest(len(fp), pairs)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)


def edges(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that suffice to connect all pairs within the radius."""
    blocks = radius + 2
    width = BITS // blocks
    keys = []
    for i in range(blocks):
        for j in range(i + 1, blocks):
            mask = ((1 << width) - 1) << (i * width) | ((1 << width) - 1) << (j * width)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(len(keys)).alias("table"), F.col("fp").bitwiseAND(F.lit(signed)).alias("part")))
    placed = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("k")).select("fp", "pop", "k.table", "k.part")
    # Of each bucket: how many fingerprints have each population count (65 at most).
    counts = placed.groupBy("table", "part", "pop").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("table", "part").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("cuts")))).alias("cuts")
    ).where("size > 1")
    crowded = placed.join(buckets, ["table", "part"])
    small = F.col("size") <= tile
    whole = crowded.where(small).select("table", "part", F.lit(0).alias("p1"), F.lit(0).alias("c1"), F.lit(0).alias("p2"), F.lit(0).alias("c2"), F.lit(0).alias("side"), "fp")
    cut = F.pmod(F.xxhash64("fp"), F.expr("cuts[pop]")).cast("int")
    # A row goes to the pairs of its tile with every tile whose population count is near enough.
    partners = F.expr(
        f"flatten(transform(filter(map_entries(cuts), e -> abs(e.key - pop) <= {radius}), e -> transform(sequence(0, e.value - 1), c -> struct(e.key as p, c as c))))"
    )
    tiled = (
        crowded.where(~small)
        .withColumn("cut", cut)
        .withColumn("q", F.explode(partners))
        .withColumn("first", F.expr("pop < q.p or (pop = q.p and cut <= q.c)"))
        .select(
            "table", "part",
            F.expr("if(first, pop, q.p)").alias("p1"), F.expr("if(first, cut, q.c)").alias("c1"),
            F.expr("if(first, q.p, pop)").alias("p2"), F.expr("if(first, q.c, cut)").alias("c2"),
            F.expr("if(first, 0, 1)").alias("side"), "fp",
        )
    )
    names = ["table", "part", "p1", "c1", "p2", "c2"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by tile pair; a pair that goes on in the next batch waits for it."""
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            ids = frame[names].to_numpy()
            last = np.flatnonzero((ids != ids[-1]).any(axis=1))
            cut_at = last[-1] + 1 if len(last) else 0
            rest = frame.iloc[cut_at:]
            if cut_at:
                yield flush(frame.iloc[:cut_at])
        if rest is not None and len(rest):
            yield flush(rest)

    def flush(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame[names].to_numpy()
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        fp, side = frame["fp"].to_numpy().view(np.uint64), frame["side"].to_numpy()
        a, b = [], []
        for lo, hi in zip(new, np.r_[new[1:], len(frame)], strict=True):
            if hi - lo > 1:
                x, y = _compare(fp[lo:hi], side[lo:hi], radius)
                a.append(x)
                b.append(y)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    tasks = whole.unionByName(tiled)
    return tasks.repartition(tasks_for(distinct), *names).sortWithinPartitions(*names).mapInPandas(run, "a long, b long").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fp and component (the smallest ``rep`` reachable) of nodes (fp, rep) joined by links (a, b).

    Every round takes the smallest label among a node and its neighbours, then follows the label once
    (labels are nodes' own fingerprints until the end). Only linked nodes take part.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "simhash-links")
    ordered = nodes.select("fp", F.struct(F.col("rep").isNull().alias("none"), "rep", "fp").alias("label"))
    linked = both.select(F.col("a").alias("fp")).distinct()
    labels = staged(ordered.join(linked, "fp"), "simhash-labels")
    while True:
        near = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        low = labels.join(near, "fp", "left").select("fp", F.least("label", F.coalesce("near", "label")).alias("low"), F.col("label").alias("was"))
        low = staged(low, "simhash-low")
        jump = low.select(F.col("fp").alias("to"), F.col("low").alias("next"))
        after = low.join(jump, F.col("low.fp") == F.col("to"), "left").select("fp", F.least("low", F.coalesce("next", "low")).alias("label"), "was")
        after = staged(after, "simhash-labels")
        labels = after.select("fp", "label")
        if not after.where(~F.col("label").eqNullSafe(F.col("was"))).limit(1).count():
            return labels.select("fp", F.col("label.rep").alias("component"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """key, fp, component: one row per document."""
    printed = staged(fingerprints(docs, key, text, shingle), "simhash-fp")
    nodes = staged(printed.groupBy("fp").agg(F.min(F.col(f"`{key}`")).alias("rep")), "simhash-nodes")
    found = components(nodes, edges(nodes.select("fp"), radius, tile))
    comp = nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return printed.join(comp, "fp").select(F.col(f"`{key}`"), "fp", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest key, then text; a null key comes last."""
    start(docs.sparkSession)
    fp, comp = fresh_name("fp", docs), fresh_name("component", docs)

    def run(batch) -> dict:
        return {fp: np.array([fingerprint(t, shingle) for t in raw_texts(batch, text)], dtype=np.uint64).view(np.int64)}

    printed = staged(rowwise(docs, [text], run, f"`{fp}` long", keep=docs.columns), "simhash-docs")
    nodes = staged(printed.select(F.col(f"`{fp}`").alias("fp")).distinct().withColumn("rep", F.col("fp")), "simhash-nodes")
    found = components(nodes, edges(nodes.select("fp"), radius, tile)).withColumnsRenamed({"fp": fp, "component": comp})
    # Fingerprints without a link are groups of their own. The window keeps one row of a group already before the shuffle.
    joined = printed.join(found, fp, "left").withColumn(comp, F.coalesce(F.col(f"`{comp}`"), F.col(f"`{fp}`")))
    nr = fresh_name("nr", docs)
    first = Window.partitionBy(F.col(f"`{comp}`")).orderBy(F.col(f"`{key}`").asc_nulls_last(), F.col(f"`{text}`").asc_nulls_first())
    return joined.withColumn(nr, F.row_number().over(first)).where(F.col(nr) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(fps: list[int], radius: int) -> list[int]:
    """Component (smallest index) of each fingerprint, by comparing all pairs; for tests."""
    a = np.array(fps, dtype=np.uint64)
    return _forest(len(a), _links(a, None, radius)).tolist()


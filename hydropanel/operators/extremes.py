"""Smallest distance between clusters and largest within one, exactly, without comparing all rows.

A bounded number of rows, dealt over the clusters, are pivots. Every row belongs to the block of the nearest pivot of its own cluster; a block has a
radius. One pass over the rows gives the radii and, from the distances between rows and pivots, a first value of both extremes. A
pair of blocks whose bounds cannot beat these values is never looked at, and of the other pairs only those rows are sent whose own distance to the
other pivot leaves room for a better one. What is sent for a pair is cut into parts of bounded size, so one large pair is many tasks.

Rows without clusters of their own prune little, and each would be sent to most of the pivots. What would be sent is counted first; if plain blocks
of rows send less, the caller compares those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.operators.pairs import block_count, cogroup_spread, distances, pieces
from hydropanel.sources import checkpoint_table

# Pivots at most, whatever the number of rows; they and a row of figures for each are all the driver sees.
PIVOTS = 256
PART = 20_000
# So many rows are sent in any case.
FEW = 1_000_000
# Rows sent in one batch.
_BATCH = 5_000
# Distances of many dimensions are exact to about 1e-8 of the extent; bounds are widened by more than that.
_SLACK = 1e-6


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def pivots(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Clusters and vectors of the pivots, first rows of each cluster by a hash of their id; None with more clusters than ``PIVOTS``."""
    owners = rows.select("own").distinct().limit(PIVOTS + 1).collect()
    if len(owners) > PIVOTS:
        return None
    if not owners:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    each = max(1, min(PIVOTS, math.ceil(math.sqrt(rows.count()))) // len(owners))
    order = F.struct(F.md5(F.col("id").cast("string")).alias("hash"), "v")
    nr = F.row_number().over(Window.partitionBy("own").orderBy(order))
    chosen = rows.select("own", "v", nr.alias("nr")).where(F.col("nr") <= each).orderBy("own", "nr").collect()
    return np.array([r["own"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], float).reshape(len(chosen), -1)


def extremes(df: DataFrame, row_id: str, vec: str, cluster: str, part: int = PART, few: int | None = None) -> tuple[DataFrame, float] | None:
    """One row (between, within), and the share of all pairs of rows that had to be compared. Rows without a cluster do not count.

    None if there are too many clusters, or if more rows than ``few`` had to be sent and more than ``blocked_pairs`` sends.
    """
    few = FEW if few is None else few
    rows = checkpoint_table(df.select(F.col(row_id).alias("id"), F.col(cluster).cast("long").alias("own"), F.col(vec).alias("v")).where("own is not null and v is not null"))
    chosen = pivots(rows)
    if chosen is None:
        return None
    owner, centre = chosen
    spark = df.sparkSession
    if not len(owner):
        return spark.createDataFrame([(None, None)], "between double, within double"), 0.0
    blocks = len(owner)

    def place(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, whether they are of the own cluster, the block."""
        d = distances(_vectors(frame["v"]), centre)
        mine = frame["own"].to_numpy()[:, None] == owner
        return d, mine, np.where(mine, d, np.inf).argmin(axis=1)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            d, mine, block = place(frame)
            radius, count = np.full(blocks, -1.0), np.bincount(block, minlength=blocks)
            np.maximum.at(radius, block, d[np.arange(len(d)), block])
            near, far = np.where(mine, np.inf, d).min(initial=np.inf), np.where(mine, d, 0.0).max(initial=0.0)
            yield pd.DataFrame({"block": np.arange(blocks), "radius": radius, "n": count, "near": near, "far": far})[count > 0]

    figures = rows.mapInPandas(measure, "block int, radius double, n long, near double, far double")
    told = {r["block"]: r for r in figures.groupBy("block").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()}
    radius = np.array([told[b]["radius"] if b in told else 0.0 for b in range(blocks)])
    size = np.array([told[b]["n"] if b in told else 0 for b in range(blocks)])
    near, far = min(r["near"] for r in told.values()), max(r["far"] for r in told.values())
    apart = distances(centre, centre)
    first, slack = (None if np.isinf(near) else near, far), _SLACK * float(apart.max() + radius.max())
    near, far = near + slack, far - slack
    reach = radius[:, None] + radius
    same = owner[:, None] == owner
    here = (size > 0)[:, None] & (size > 0) & np.triu(np.ones((blocks, blocks), bool))
    visit = here & np.where(same, apart + reach > far, apart - reach < near)

    def chosen_pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and the blocks they are sent to, and the blocks of all rows."""
        d, mine, block = place(frame)
        useful = np.where(mine, d + radius > far, d - radius < near)
        a, b = np.minimum(block[:, None], np.arange(blocks)), np.maximum(block[:, None], np.arange(blocks))
        return *np.nonzero(useful & visit[a, b]), block

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"n": [len(chosen_pairs(frame)[0])]})

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            i, j, block = chosen_pairs(frame)
            v = frame["v"].to_numpy()
            for lo in range(0, len(i), _BATCH):
                row, other = i[lo : lo + _BATCH], j[lo : lo + _BATCH]
                own = block[row]
                yield pd.DataFrame({"a": np.minimum(own, other), "b": np.maximum(own, other), "left": own <= other, "v": v[row]})

    n = int(size.sum())
    plain = n * block_count(spark, n)
    # Few rows need no count: there is no way to send more.
    if n * blocks > max(few, plain) and (rows.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0) > max(few, plain):
        return None
    sent = checkpoint_table(rows.mapInPandas(send, "a int, b int, left boolean, v array<double>").withColumn("slice", F.rand(0)))
    counts = sent.groupBy("a", "b").agg(F.count_if("left").alias("na"), F.count_if(~F.col("left")).alias("nb"))
    # A block against itself has one side only.
    counts = counts.withColumn("nb", F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("nb"))).where("na > 0 and nb > 0")
    compared = counts.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")))).first()[0] or 0.0
    cuts = counts.select("a", "b", F.ceil(F.col("na") / part).cast("int").alias("ca"), F.ceil(F.col("nb") / part).cast("int").alias("cb"))
    marked = sent.join(cuts, ["a", "b"])

    def dealt(rows_of: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.least(F.floor(F.col("slice") * F.col(f"c{own}")), F.col(f"c{own}") - 1).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"c{other}") - 1))
        return rows_of.select("a", "b", mine.alias(f"s{own}"), "v", every.alias(f"s{other}")).select("a", "b", "sa", "sb", "v")

    one = dealt(marked.where("left"), "a", "b")
    two = dealt(marked.where(~F.col("left") | (F.col("a") == F.col("b"))), "b", "a")
    two = two.select(*[F.col(c).alias(c) for c in two.columns])

    def compare(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        best = np.nan
        if len(lpdf) and len(rpdf):
            x, y = _vectors(lpdf["v"]), _vectors(rpdf["v"])
            for i in pieces(len(x)):
                for j in pieces(len(y)):
                    d = distances(x[i], y[j])
                    best = np.fmax(best, d.max()) if owner[a] == owner[b] else np.fmin(best, d.min())
        inside = owner[a] == owner[b]
        return pd.DataFrame({"between": [None if inside or np.isnan(best) else best], "within": [best if inside and not np.isnan(best) else None]}, dtype=object)

    found = cogroup_spread(one, two, ["a", "b", "sa", "sb"], compare, "between double, within double")
    # The pairs of rows and pivots are pairs of rows too.
    known = spark.createDataFrame([first], "between double, within double")
    return found.unionByName(known).agg(F.min("between").alias("between"), F.max("within").alias("within")), 2 * compared / max(1, n * (n - 1))

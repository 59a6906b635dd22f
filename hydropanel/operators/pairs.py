"""Work over pairs of rows without joining rows to rows.

``blocked_pairs`` cuts the rows into blocks of bounded size and gives every pair of
blocks to one task, which reduces its distances to small sums on the spot.  No
pair is ever a Spark row, and neither a crowded tile nor a single group is ever a
task: a place with many rows simply gets more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydropanel.sources import checkpoint_table

# Half of the eight neighbours, so that two tiles meet once.
_FORWARD = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))

# Rows of a block at most. A row is copied once per partner block, so blocks are large;
# the tasks go through a pair of blocks in pieces of ``PIECE`` rows.
BLOCK_ROWS = 50_000
PIECE = 1000
# Rows of a tile that meet its surroundings in one task of ``pairs_within``.
TILE_ROWS = 4000


def block_count(spark: SparkSession, rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks that ``blocked_pairs`` cuts so many rows into without tiles: about as many copies of a row are sent."""
    return max(math.ceil(rows / block_rows), min(math.ceil(rows / PIECE), _spread(spark)))


def _spread(spark: SparkSession) -> int:
    """Enough blocks for every core to have a pair of them."""
    return math.ceil(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def blocked_pairs(
    df: DataFrame,
    row_id,
    fn: Callable[[bool, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    tiles: tuple[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``fn(same_block, left, right)`` once per unordered pair of row blocks.

    With ``tiles`` (two integer columns) only blocks of the same or of adjacent
    tiles meet.  ``row_id`` is hashed to spread the rows over the blocks of a tile.
    The rows are read for their number and for both sides, so they are written to the
    shared folder first and their own plan runs once.
    """
    df = checkpoint_table(df)
    # Enough blocks for every core to have a pair of them, unless they would become smaller than a piece.
    spread = _spread(df.sparkSession) if tiles is None else 1
    n = F.count(F.lit(1))
    n_blocks = F.greatest(F.ceil(n / block_rows), F.least(F.ceil(n / PIECE), F.lit(spread))).cast("int").alias("_nb")
    if tiles is None:
        # one group: its size is a scalar, and every block meets every later one
        tile = {c: F.lit(0).cast("long") for c in ("_tx", "_ty")}
        rows = df.withColumns(tile).withColumn("_nb", df.select(n_blocks).scalar())
        meetings = df.agg(n_blocks).withColumns(tile).select(
            "_tx", "_ty", F.col("_nb").alias("_na"), F.lit(0).cast("long").alias("_ux"), F.lit(0).cast("long").alias("_uy"), "_nb"
        )
    else:
        df = df.withColumns({"_tx": F.col(tiles[0]).cast("long"), "_ty": F.col(tiles[1]).cast("long")})
        sizes = df.groupBy("_tx", "_ty").agg(n_blocks)
        rows = df.join(sizes, ["_tx", "_ty"])
        offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _FORWARD])
        a = sizes.select("_tx", "_ty", F.col("_nb").alias("_na"), F.inline(offsets)).select(
            "_tx", "_ty", "_na", (F.col("_tx") + F.col("dx")).alias("_ux"), (F.col("_ty") + F.col("dy")).alias("_uy")
        )
        b = sizes.select(F.col("_tx").alias("_ux"), F.col("_ty").alias("_uy"), "_nb")
        meetings = a.join(b, ["_ux", "_uy"])
    rows = rows.withColumn("_i", F.pmod(F.xxhash64(row_id), F.col("_nb")).cast("int")).drop("_nb")

    same_tile = (F.col("_tx") == F.col("_ux")) & (F.col("_ty") == F.col("_uy"))
    tasks = (
        meetings.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
        .repartition("_tx", "_ty", "_i")  # a place with many blocks lists its tasks on many executors
        .withColumn("_j", F.explode(F.sequence(F.when(same_tile, F.col("_i")).otherwise(F.lit(0)), F.col("_nb") - 1)))
        .select("_tx", "_ty", "_i", "_ux", "_uy", "_j")
    )
    key = ["_tx", "_ty", "_i", "_ux", "_uy", "_j"]
    left = rows.join(tasks, ["_tx", "_ty", "_i"])
    # a block against itself is sent once
    others = tasks.where(~(same_tile & (F.col("_i") == F.col("_j"))))
    right = rows.withColumnsRenamed({"_tx": "_ux", "_ty": "_uy", "_i": "_j"}).join(others, ["_ux", "_uy", "_j"])
    # both sides come from the same table: new columns tell them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(k, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        same = tuple(k[:3]) == tuple(k[3:])
        return fn(same, lpdf, lpdf if same else rpdf)

    return cogroup_spread(left, right, key, run, schema)


def cogroup_spread(left: DataFrame, right: DataFrame, key: list[str], fn: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """Cogrouped pandas (or with ``arrow`` PyArrow) function over all shuffle partitions.

    Adaptive execution merges partitions by bytes; these tasks are small in bytes and
    long in work, so both sides are given the session's partition number explicitly.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n, *key), right.repartition(n, *key)
    groups = left.groupBy(*key).cogroup(right.groupBy(*key))
    return groups.applyInArrow(fn, schema) if arrow else groups.applyInPandas(fn, schema)


def pieces(rows: int) -> list[slice]:
    return [slice(lo, lo + PIECE) for lo in range(0, rows, PIECE)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks."""
    square = squares(a, b)
    return np.sqrt(square, out=square)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two blocks."""
    if a.shape[1] <= 4:
        return sum((a[:, [i]] - b[:, i]) ** 2 for i in range(a.shape[1]))
    # centred first, so that the expanded square loses little
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    square = -2 * (a @ b.T)
    square += (a * a).sum(axis=1)[:, None]
    square += (b * b).sum(axis=1)
    return np.maximum(square, 0.0, out=square)


def pairs_within(df: DataFrame, row_id: str, x: str, y: str, max_dist: float | None = None) -> DataFrame:
    """Pairs of rows with their distance, each once; with ``max_dist`` only those no farther apart.

    A tile equi-join: one side is copied to its own tile and half of those around it, so rows meet only their surroundings and
    tiles meet once; the exact distance is part of the join condition. The rows are few in bytes and many in pairs, so both
    sides are dealt over all shuffle partitions, and a crowded tile is cut into slices. Without a radius see ``_all_pairs``.
    """
    if max_dist is None:
        return _all_pairs(df, row_id, x, y)
    tile = float(max_dist)
    base = df.select(
        F.col(row_id).alias("id"),
        F.col(x).alias("x"),
        F.col(y).alias("y"),
        F.floor(F.col(x) / tile).alias("tx"),
        F.floor(F.col(y) / tile).alias("ty"),
    )
    base = checkpoint_table(base.where(F.col("id").isNotNull() & F.col("tx").isNotNull() & F.col("ty").isNotNull()))
    sizes = base.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("nb"))
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _FORWARD])
    copies = base.select("id", "x", "y", "tx", "ty", F.inline(around)).select(
        "id", "x", "y", (F.col("tx") + F.col("dx")).alias("tx"), (F.col("ty") + F.col("dy")).alias("ty"), ((F.col("dx") != 0) | (F.col("dy") != 0)).alias("moved")
    )
    n, key = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["tx", "ty", "slice"]
    one = base.join(sizes, ["tx", "ty"]).withColumn("slice", F.pmod(F.xxhash64("id", "x", "y"), F.col("nb")).cast("int")).drop("nb")
    two = copies.join(sizes, ["tx", "ty"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    a, b = one.repartition(n, *key).alias("a"), two.repartition(n, *key).alias("b")
    d2 = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2)
    near = (
        (F.col("a.tx") == F.col("b.tx"))
        & (F.col("a.ty") == F.col("b.ty"))
        & (F.col("a.slice") == F.col("b.slice"))
        & ((F.col("a.id") < F.col("b.id")) | (F.col("b.moved") & (F.col("a.id") > F.col("b.id"))))
        & (d2 <= max_dist * max_dist)
    )
    return a.join(b, near).select(
        F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), F.sqrt(d2).alias("distance")
    )


def _all_pairs(df: DataFrame, row_id: str, x: str, y: str) -> DataFrame:
    """Every pair of rows with different ids, those without a place too (distance NULL).

    Pairs of blocks are the keys of an equi-join dealt over all shuffle partitions: a row is sent once per block, a task holds one block of its partition
    at a time, and nothing else is written. The rows returned grow with the square of the input.
    """
    base = checkpoint_table(df.select(F.col(row_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).where("id IS NOT NULL"))
    spark, rows = df.sparkSession, base.count()
    blocks = max(1, math.ceil(rows / BLOCK_ROWS), min(math.ceil(rows / PIECE), 4 * _spread(spark)))
    n, key = int(spark.conf.get("spark.sql.shuffle.partitions")), ["i", "j"]
    own, first, last = F.pmod(F.xxhash64("id", "x", "y"), F.lit(blocks)).cast("int"), F.lit(0), F.lit(blocks - 1)
    one = base.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.col("i"), last)))
    two = base.withColumn("j", own).withColumn("i", F.explode(F.sequence(first, F.col("j"))))
    a, b = one.repartition(n, *key).alias("a"), two.repartition(n, *key).alias("b")
    once = (F.col("a.id") < F.col("b.id")) | ((F.col("a.i") < F.col("a.j")) & (F.col("a.id") > F.col("b.id")))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    return a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & once).select(
        F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), F.sqrt(dx * dx + dy * dy).alias("distance")
    )

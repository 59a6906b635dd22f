"""Ordered windows over series that are too long for one task.

A key with more than ``range_rows`` rows is split into ranges of the order column. Each range is then a window partition of its own, and
gets the rows that stand just outside it as border rows, which are dropped after the window. Short keys are windows as ever, in the same
shuffle. The ranges are found by one count and approximate quantiles of the long keys; border rows by ``row_number`` limits, which Spark
applies inside the map tasks, so only a few rows per range are shuffled for them.

A range may hold fewer rows than a frame reaches: border rows are found by their place in the whole series, from as many ranges as
needed. The order column is unique within a key (equal values stay in one range); nulls stand first. Null keys are a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hydropanel.sources import checkpoint_table

# Ranges of a key at most; a longer series has longer ranges.
MOST_RANGES = 1_000


def _with(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", also: Column | None = None) -> DataFrame:
    """A join on keys of which nulls are equal."""
    names = {k: f"_of_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] + ([] if also is None else [also])
    return df.join(small.withColumnsRenamed(names), reduce(and_, same), how).drop(*names.values())


def split(rows: DataFrame, keys: list[str], order: str, range_rows: int) -> DataFrame | None:
    """``rows`` with the number ``_range`` of each row's range, null for short keys; None if all keys are short."""
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > range_rows)
    most = long.agg(F.max("_rows")).first()[0]
    if most is None:
        return None
    n = min(MOST_RANGES, math.ceil(most / range_rows))
    at = F.percentile_approx(order, [i / n for i in range(1, n)], 20 * MOST_RANGES)
    bounds = _with(rows, long.drop("_rows"), keys, "inner").groupBy(*keys).agg(F.array_distinct(F.coalesce(at, F.array())).alias("_bounds"))
    # By halves: going through all bounds for every row would cost as much as rows times ranges.
    halves = F.array(*[F.lit(2**k) for k in reversed(range(n.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda lo, step: F.when(F.get("_bounds", lo + step - 1) < F.col(order), lo + step).otherwise(lo))
    numbered = _with(rows, bounds, keys)
    return numbered.withColumn("_range", F.when(F.col("_bounds").isNotNull(), F.coalesce(F.when(F.col(order).isNotNull(), below), F.lit(0)))).drop("_bounds")


def borders(placed: DataFrame, keys: list[str], order: str, before: int, after: int) -> DataFrame:
    """The rows each range needs from others: up to ``before`` ahead of its first row and ``after`` behind its last one."""
    long = placed.where(F.col("_range").isNotNull())
    reach = max(before, after)
    by_range = Window.partitionBy(*keys).orderBy("_range")
    spans = long.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    spans = checkpoint_table(spans.withColumn("_hi", F.sum("_n").over(by_range)).withColumn("_lo", F.col("_hi") - F.col("_n")))

    def ends(column: Column, place: str) -> DataFrame:
        nr = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(column))
        few = long.withColumn("_nr", nr).where(F.col("_nr") <= reach)
        spot = spans.withColumnRenamed("_range", "_own")
        return _with(few, spot, keys, "inner", F.col("_range") == F.col("_own")).withColumn("_at", F.expr(place)).drop("_nr", "_own")

    heads = ends(F.col(order).asc(), "_lo + _nr - 1")
    tails = ends(F.col(order).desc(), "_hi - _nr").where(F.col("_at") - F.col("_lo") >= reach)  # those not among the heads
    some = heads.unionByName(tails).drop("_lo", "_hi", "_n", "_range")
    # A range meets the rows near its first and its last place: joined by the place itself, not by comparing all with all.
    edges = spans.select(*keys, "_range", F.inline(F.array(*[
        F.struct(F.expr(place).alias("_place"), F.lit(first).alias("_first")) for place, first in (("_lo", True), ("_hi - 1", False))
    ])))
    near = some.withColumn("_near", F.explode(F.sequence(F.col("_at") - after, F.col("_at") + before)))
    needed = F.when(F.col("_first"), F.col("_at") < F.col("_place")).otherwise(F.col("_at") > F.col("_place"))
    return _with(near, edges, keys, "inner", (F.col("_near") == F.col("_place")) & needed).drop("_near", "_place", "_first", "_at")


def over(df: DataFrame, keys, order: str, values: Callable[[WindowSpec], dict[str, Column]], before: int, after: int, range_rows: int) -> DataFrame:
    """``df`` with the columns that ``values`` makes from a window by ``keys`` and ``order``, of which a row sees at most ``before``
    rows ahead of it and ``after`` rows behind it."""
    keys = list(keys)
    rows = checkpoint_table(df)  # read several times
    placed = split(rows, keys, order, range_rows)
    if placed is None:
        return rows.withColumns(values(Window.partitionBy(*keys).orderBy(order)))
    outside = borders(placed, keys, order, before, after).withColumn("_border", F.lit(True))
    all_rows = placed.withColumn("_border", F.lit(False)).unionByName(outside)
    out = all_rows.withColumns(values(Window.partitionBy(*keys, "_range").orderBy(order)))
    return out.where(~F.col("_border")).select(*df.columns, *[c for c in out.columns if c not in placed.columns and c != "_border"])

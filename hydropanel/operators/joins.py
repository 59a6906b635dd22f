"""Equi-joins of the panel.

No join carries a broadcast hint: the planner broadcasts a side below
``autoBroadcastJoinThreshold``, adaptive execution re-decides from the written
size, and otherwise the sort-merge join has its hot partitions split.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col


def attach(facts: DataFrame, dim: DataFrame, key, cols=None) -> DataFrame:
    """Attributes onto facts by one key (inner)."""
    keys = [key] if isinstance(key, str) else list(key)
    if cols is not None:
        dim = dim.select(*keys, *cols)
    return facts.join(dim, keys, "inner")


def match(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Inner equi-join on several keys; null keys never match."""
    return a.join(b, list(keys), "inner")


def attach_left(facts: DataFrame, other: DataFrame, keys) -> DataFrame:
    return facts.join(other, list(keys), "left")


def lookup_all(y: DataFrame, x: DataFrame, key: str) -> DataFrame:
    """All rows of ``y`` with their matches in ``x``."""
    return y.join(x, key, "left")


def with_prior(df: DataFrame, keys, time: str, cols: dict[str, str], k: int = 1, how: str = "inner") -> DataFrame:
    """Value of exactly ``k`` periods before; a gap does not match.

    ``cols`` maps source columns to the names of their prior values.  The table has
    one row per key and period, so a window partition is bounded by the number of
    periods, and a frame of exactly one period is a self-join without its second
    read of the input.  ``how`` is ``inner`` (rows without a prior period are dropped)
    or ``left``.
    """
    frame = Window.partitionBy(*keys).orderBy(time).rangeBetween(-k, -k)
    out = df.withColumns(
        {n: F.first(c).over(frame) for c, n in cols.items()} | {"_found": F.count(F.lit(1)).over(frame)}
    )
    if how == "inner":
        out = out.filter(F.col("_found") > 0)
    return out.drop("_found")


def keep_in(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    return df.join(ids, key, "left_semi")


def drop_in(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    return df.join(ids, key, "left_anti")


def with_group(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """One-row-per-group statistics onto the rows; rows with a NULL key are a group too."""
    names = {k: f"_key_{k}" for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(stats.withColumnsRenamed(names), same).drop(*names.values())


def name_of(df: DataFrame, key: str, mapping: dict, name: str = "cluster_name") -> DataFrame:
    """Code to name through a literal map; the mapping is a written-down table."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), as_col(key)))


def apply_params(df: DataFrame, params: DataFrame, group) -> DataFrame:
    """Model coefficients of a group onto that group's rows."""
    return df.join(params, [group] if isinstance(group, str) else list(group), "inner")


def grid(df: DataFrame, name: str, values) -> DataFrame:
    """Every row with each parameter value: a narrow explode, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def bind_by_key(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Two result tables side by side, on their real key."""
    return a.join(b, list(keys), "inner")

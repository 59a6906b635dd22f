"""Values kept on every row: group statistics, shares, shifts, standard scores.

Two plans for a group statistic, chosen by what the caller knows of the table:

* Rows of any number per group: an aggregate joined back to the rows.  A window
  would put all rows of a station or region into one task; the aggregate reaches
  the shuffle as partial rows, and the join back is a broadcast when the statistics
  are small and otherwise a merge join with its hot keys split.
* ``period`` names a column that is unique inside a group (a panel with one row per
  station and month, say).  A group then has at most as many rows as there are
  periods, however the raw rows were spread, and one window gives the statistic
  without a second pass over the input.  Successive operators of one station share
  a single shuffle.

The ordered windows (``gap``, ``shift``, ``centered_mean``) are for such panels; with ``range_rows`` they take series of any length, as keys
with more rows are split into ranges of time (``ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col
from hydropanel.operators.joins import with_group
from hydropanel.operators.ranges import over


def add_group_agg(df: DataFrame, keys, aggs: dict[str, Column], period: str | None = None) -> DataFrame:
    """Group aggregates on every row."""
    keys = list(keys)
    if period is not None:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return with_group(df, stats, keys)


def share_of_peak(df: DataFrame, site: str, year: str, month: str, col: str) -> DataFrame:
    """Month peak over year peak: one pass over the rows, then at most 12 rows per year."""
    months = df.groupBy(site, year, month).agg(F.max(col).alias("month_peak"))
    out = add_group_agg(months, [site, year], {"year_peak": F.max("month_peak")}, period=month)
    return out.withColumn("share", F.try_divide("month_peak", "year_peak"))


def _ordered(df: DataFrame, part, order, values, before: int, after: int, range_rows: int | None) -> DataFrame:
    """One window by key, or, with ``range_rows``, windows by ranges of long keys."""
    if range_rows is None:
        return df.withColumns(values(Window.partitionBy(*part).orderBy(*order)))
    (one,) = order
    return over(df, part, one, values, before, after, range_rows)


def gap(df: DataFrame, site: str, time: str, name: str = "gap", range_rows: int | None = None) -> DataFrame:
    """Difference to the period before, NULL on the first."""
    return _ordered(df, [site], [time], lambda w: {name: F.col(time) - F.lag(time).over(w)}, 1, 0, range_rows)


def shift(df: DataFrame, part, order, col: str, k: int = 1, name: str | None = None, range_rows: int | None = None) -> DataFrame:
    """Value ``k`` rows ahead (negative: behind)."""
    return _ordered(df, part, order, lambda w: {name or f"{col}_shift": F.lead(col, k).over(w)}, max(0, -k), max(0, k), range_rows)


def centered_mean(df: DataFrame, part, order, cols: dict[str, str], width: int = 5, range_rows: int | None = None) -> DataFrame:
    """Centred moving mean; NULL at the edges and where a value is missing."""
    half = width // 2

    def means(w) -> dict[str, Column]:
        w = w.rowsBetween(-half, half)
        return {n: F.when(F.count(c).over(w) == width, F.avg(c).over(w)) for c, n in cols.items()}

    return _ordered(df, part, order, means, half, half, range_rows)


def residual(
    df: DataFrame, part, col: str, name: str | None = None, weight: str | None = None, period: str | None = None
) -> DataFrame:
    """Value minus the mean of its group; ``weight`` counts the rows behind a reduced row."""
    out = df
    if weight is None:
        out = add_group_agg(out, part, {"_s": F.sum(col), "_n": F.count(col)}, period)
    else:
        out = add_group_agg(out, part, {"_s": F.sum(F.col(col) * F.col(weight)), "_n": F.sum(weight)}, period)
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    return out.withColumn(name or f"{col}_residual", F.col(col) - mean).drop("_s", "_n")


def any_nonzero(df: DataFrame, part, col: str, name: str = "any_nonzero", period: str | None = None) -> DataFrame:
    """Whether the group has a value other than zero."""
    out = add_group_agg(df, part, {name: F.max(F.abs(F.col(col)))}, period)
    return out.withColumn(name, F.coalesce(F.col(name) > 0, F.lit(False)))


def zscore(df: DataFrame, part, cols: dict[str, str], period: str | None = None) -> DataFrame:
    """Standard score by the group's own mean and sample deviation.

    NULL for groups of one row and for constant values.
    """
    aggs: dict[str, Column] = {}
    for c in cols:
        aggs |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = add_group_agg(df, part, aggs, period)
    return out.withColumns(
        {n: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c, n in cols.items()}
    ).drop(*aggs)


def unzscore(df: DataFrame, part, z_cols: dict[str, str], base_col: str, period: str | None = None) -> DataFrame:
    """Scores back to the unit of ``base_col`` with the group's own statistics."""
    out = add_group_agg(df, part, {"_m": F.avg(base_col), "_s": F.stddev_samp(base_col)}, period)
    return out.withColumns({n: as_col(c) * F.col("_s") + F.col("_m") for c, n in z_cols.items()}).drop("_m", "_s")

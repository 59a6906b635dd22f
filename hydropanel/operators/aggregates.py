"""Grouped aggregates.

Hash aggregates combine inside each map task first, so a group that holds a third
of all rows reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col
from hydropanel.operators.joins import with_group
from hydropanel.operators.rows import complete


def strict(agg, col) -> Column:
    """An aggregate that is NULL as soon as one value of the group is NULL."""
    c = as_col(col)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def _agg(fn, col, na_rm: bool) -> Column:
    return fn(as_col(col)) if na_rm else strict(fn, col)


def _named(cols) -> dict[str, str]:
    return cols if isinstance(cols, dict) else {c: c for c in cols}


def group_mean(df: DataFrame, keys, cols, na_rm: bool = True) -> DataFrame:
    """``cols`` maps source columns to result names (or is a list)."""
    return df.groupBy(*keys).agg(*[_agg(F.avg, c, na_rm).alias(n) for c, n in _named(cols).items()])


def group_mean_sd(df: DataFrame, keys, cols: dict[str, tuple[str, str]], na_rm: bool = True) -> DataFrame:
    """Mean and sample deviation; the deviation of one row is NULL."""
    aggs = []
    for c, (mean_name, sd_name) in cols.items():
        aggs += [_agg(F.avg, c, na_rm).alias(mean_name), _agg(F.stddev_samp, c, na_rm).alias(sd_name)]
    return df.groupBy(*keys).agg(*aggs)


def group_sum(df: DataFrame, keys, cols, na_rm: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(*[_agg(F.sum, c, na_rm).alias(n) for c, n in _named(cols).items()])


def group_min_max(df: DataFrame, keys, cols: dict[str, tuple[str, str]]) -> DataFrame:
    aggs = []
    for c, (lo, hi) in cols.items():
        aggs += [F.min(c).alias(lo), F.max(c).alias(hi)]
    return df.groupBy(*keys).agg(*aggs)


def record_span(
    df: DataFrame,
    site: str = "site_number",
    year: str = "year",
    max_gap: int = 3,
    first_by: int = 1980,
    last_from: int = 2020,
) -> DataFrame:
    """Sites whose record has no long gap and covers the required span.

    Years are made distinct before the window, so a window partition is at most
    the number of years of one site.
    """
    w = Window.partitionBy(site).orderBy(year)
    years = df.select(site, year).distinct().withColumn("_gap", F.col(year) - F.lag(year).over(w))
    span = years.groupBy(site).agg(
        F.max("_gap").alias("max_gap"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    )
    return span.filter(
        (F.col("max_gap") <= max_gap) & (F.col("first_year") <= first_by) & (F.col("last_year") >= last_from)
    )


def fraction(df: DataFrame, keys, predicate: Column, name: str = "fraction") -> DataFrame:
    """Share of rows that meet a predicate."""
    return df.groupBy(*keys).agg((F.count_if(predicate) / F.count(F.lit(1))).alias(name))


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """First row per key by an explicit order.

    ``row_number() = 1`` is planned with a group limit before the shuffle: a map
    task hands on one row per key, however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def distinct_values(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).distinct()


def two_level_mean(df: DataFrame, site: str, region: str, col: str) -> DataFrame:
    """Mean per site and row-weighted mean per region; the data are read once.

    The region level is built from the site sums, not from the rows.
    """
    per_site = df.groupBy(site, region).agg(F.sum(col).alias("_s"), F.count(col).alias("_n"))
    per_region = per_site.groupBy(region).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("region_mean"))
    return with_group(per_site, per_region, [region]).select(
        site, region, F.try_divide("_s", "_n").alias("site_mean"), "region_mean"
    )


def region_year(z: DataFrame, keys, cols) -> DataFrame:
    """Mean of the station scores per region and year, nulls skipped."""
    return group_mean(z, keys, cols, na_rm=True)


def stats_table(z: DataFrame, raw: DataFrame, keys, z_cols, raw_cols) -> DataFrame:
    """Mean and deviation of scores and of raw values, side by side.

    One aggregate when both are columns of the same table, else two and a join.
    """
    if raw is z:
        return group_mean_sd(z, keys, z_cols | raw_cols)
    return group_mean_sd(z, keys, z_cols).join(group_mean_sd(raw, keys, raw_cols), list(keys))


def gram(df: DataFrame, group, cols) -> DataFrame:
    """Sufficient statistics of every regression among ``cols``, per group.

    One pass: n, means and the covariance matrix (row-major).  Rows with a null in
    any column are left out, so all models of a family share their rows.
    """
    cols = list(cols)
    pairs = list(combinations_with_replacement(cols, 2))
    stats = complete(df.select(*group, *cols), cols).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.covar_samp(a, b).alias(f"_c_{a}_{b}") for a, b in pairs],
    )

    def cov(a: str, b: str) -> Column:
        return F.col(f"_c_{a}_{b}" if (a, b) in pairs else f"_c_{b}_{a}")

    return stats.select(
        *group,
        "n",
        F.array(*[F.col(f"_m_{c}") for c in cols]).alias("mean"),
        F.array(*[cov(a, b) for a in cols for b in cols]).alias("cov"),
    )

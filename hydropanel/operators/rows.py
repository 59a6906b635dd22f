"""Projections, filters, null rules and column updates: all narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel.functions.calendar import season_rank


def keep(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)


def cols_at(df: DataFrame, ranges) -> DataFrame:
    """Columns by 1-based inclusive position ranges or single positions."""
    names = []
    for r in ranges:
        lo, hi = (r, r) if isinstance(r, int) else r
        names += df.columns[lo - 1 : hi]
    return df.select(*names)


def derive(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.withColumns(exprs)


def update_where(df: DataFrame, predicate: Column, exprs: dict[str, Column]) -> DataFrame:
    """Overwrite columns on matching rows only; a new column is NULL elsewhere."""
    return df.withColumns(
        {c: F.when(predicate, e).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, e in exprs.items()}
    )


def pick_col(df: DataFrame, key_col: str, columns: dict, name: str) -> DataFrame:
    """The value of the column that the row's key names."""
    out = F.lit(None)
    for key, col in columns.items():
        out = F.when(F.col(key_col) == key, F.col(col)).otherwise(out)
    return df.withColumn(name, out)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def between_years(df: DataFrame, lo: int, hi: int, col: str = "year") -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def positive(df: DataFrame, cols) -> DataFrame:
    """Rows in which every named column is above zero (NULL drops the row)."""
    for c in cols:
        df = df.filter(F.col(c) > 0)
    return df


def is_in(df: DataFrame, col: str, values, negate: bool = False) -> DataFrame:
    hit = F.col(col).isin(*values)
    return df.filter(~hit if negate else hit)


def split_by_length(df: DataFrame, col: str, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows with an id of at least ``n`` characters, and the rest."""
    long_id = F.length(F.col(col)) >= n
    return df.filter(long_id), df.filter(~long_id)


def one_site(df: DataFrame, value, col: str = "site_number") -> DataFrame:
    return df.filter(F.col(col) == value)


def in_year(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """Half-open window of one calendar year; plain comparisons, so it reaches the scan."""
    start, end = (F.lit(f"{y:04d}-01-01").cast(df.schema[date_col].dataType) for y in (year, year + 1))
    return df.filter((F.col(date_col) >= start) & (F.col(date_col) < end))


def _water_years(df: DataFrame, date_col: str, lo: int, hi: int, last_month: int):
    start, end = (F.lit(f"{y:04d}-{last_month + 1:02d}-01").cast(df.schema[date_col].dataType) for y in (lo - 1, hi))
    return start, end


def in_water_years(df: DataFrame, date_col: str, lo: int, hi: int, last_month: int = 9) -> DataFrame:
    """Dates of the water years ``lo`` to ``hi``, as a half-open window that reaches the scan."""
    start, end = _water_years(df, date_col, lo, hi, last_month)
    return df.filter((F.col(date_col) >= start) & (F.col(date_col) < end))


def not_in_water_year(df: DataFrame, date_col: str, year: int, last_month: int = 9) -> DataFrame:
    """Dates outside one water year."""
    start, end = _water_years(df, date_col, year, year, last_month)
    return df.filter((F.col(date_col) < start) | (F.col(date_col) >= end))


def exclude(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) != value)


def causal_pairs(df: DataFrame, precip_season: str, runoff_season: str) -> DataFrame:
    """Pairs in which the precipitation season does not follow the runoff season."""
    return df.filter(season_rank(precip_season) <= season_rank(runoff_season))


def complete(df: DataFrame, cols=None) -> DataFrame:
    """Rows without a null, in all or in the named columns."""
    return df.na.drop(subset=list(cols) if cols else None)


def zero_nulls(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def ordered(df: DataFrame, cols) -> DataFrame:
    """Global order by range partitions (a leading '-' means descending)."""
    return df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in cols])


def display_order(df: DataFrame, col: str, ranks: dict, name: str = "order") -> DataFrame:
    """Attach the display rank of a category; the presentation sorts by it."""
    out = F.lit(None).cast("int")
    for value, rank in ranks.items():
        out = F.when(F.col(col) == value, F.lit(rank)).otherwise(out)
    return df.withColumn(name, out)


def first_n(df: DataFrame, order, n: int = 1) -> DataFrame:
    """First rows by an explicit order: each task keeps its own ``n`` before they are merged."""
    return ordered(df, order).limit(n)



"""Stacking, long and wide forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOT_FROM = 16

# Month column names of a flow regime.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def stack(dfs, fill: bool = False, by_position: bool = False) -> DataFrame:
    """Append tables by name, with missing columns as NULL, or by position."""
    if by_position:
        return reduce(DataFrame.union, dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), dfs)


def stack_results(dfs) -> DataFrame:
    """Append result tables that may differ in columns."""
    return stack(list(dfs), fill=True)


def to_long(df: DataFrame, ids, cols=None, key: str = "variable", value: str = "value") -> DataFrame:
    """Columns to rows, nulls kept."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    if len(cols) < PIVOT_FROM:
        return df.unpivot(list(ids), cols, key, value)
    # the same as one generator: the expand behind unpivot leaves generated code when it is wide
    pairs = [F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in cols]
    return df.select(*ids, F.inline(F.array(*pairs)))


def to_long_year(df: DataFrame, ids, cols, value: str = "value") -> DataFrame:
    """Columns named by years to ``(ids, year, value)``; other names give NULL years."""
    return to_long(df, ids, cols, "year", value).withColumn("year", F.expr("try_cast(year AS INT)"))


def to_long_month(df: DataFrame, ids, cols, pattern: str, value: str = "value", date_format: str | None = None) -> DataFrame:
    """Month columns to rows; the header gives the month.

    ``pattern`` has one group.  It captures the month number, or with
    ``date_format`` the text of a date from which year and month are taken.
    """
    long = to_long(df, ids, cols, "_header", value)
    text = F.regexp_extract("_header", pattern, 1)
    if date_format is None:
        return long.withColumn("month", text.cast("int")).drop("_header")
    date = F.to_date(text, date_format)
    return long.withColumns({"cal_year": F.year(date), "month": F.month(date)}).drop("_header")


def to_wide(df: DataFrame, ids, key: str, cols, values, names=None) -> DataFrame:
    """Rows to columns for a fixed list of key values.

    ``cols`` is one column, or a mapping of columns to name prefixes.  The values
    are given, so no extra job looks for them.
    """
    single = isinstance(cols, str)
    spec = {cols: ""} if single else dict(cols)
    values = list(values)
    names = list(names) if names is not None else [str(v) for v in values]
    if len(values) * len(spec) > PIVOT_FROM:
        # many columns: testing every row against every value would cost more than one more shuffle
        wide = df.groupBy(*ids).pivot(key, values).agg(*[F.max(c).alias(f"c{i}") for i, c in enumerate(spec)])
        found = wide.columns[len(ids) :]
        target = [f"{prefix}{n}" for n in names for prefix in spec.values()]
        return wide.select(*ids, *[F.col(f"`{a}`").alias(b) for a, b in zip(found, target, strict=True)])
    aggs = [
        F.max(F.when(F.col(key) == v, F.col(c))).alias(f"{prefix}{n}")
        for c, prefix in spec.items()
        for v, n in zip(values, names, strict=True)
    ]
    return df.groupBy(*ids).agg(*aggs)


def stack_cols(df: DataFrame, ids, cols, value: str = "value") -> DataFrame:
    """Several columns under one another in one column."""
    return to_long(df, ids, cols, "_which", value).drop("_which")

"""Regression state that is kept between runs: a stored triangle per group and period, merged exactly when models are wanted.

A state is a Parquet table with a folder per period. ``update`` reduces the rows of the named periods (``factors``) and replaces
their folders, so that a new or corrected period costs one pass over that period and nothing else; running it twice changes nothing.
``merged`` stacks the triangles of all periods or of some, which gives what one pass over all their rows gives, up to rounding. A period
without rows keeps a marker, so a correction may also empty it. Periods and groups may be null.

Tasks replace whole folders through Spark's committer; a lost executor costs its tasks. Two updates of one period at a time are the
caller's to avoid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from hydropanel.operators.factors import factors, stacked, triangle


def of_periods(df: DataFrame, period: str, periods) -> DataFrame:
    """Rows of the named periods; the filter is pushed to the scan or prunes its folders."""
    named = [p for p in periods if p is not None]
    wanted = F.col(period).isin(named) if named else F.lit(False)
    return df.where(wanted | F.col(period).isNull() if None in periods else wanted)


def update(path: str, df: DataFrame, group, period: str, cols, periods=None) -> None:
    """Put the triangles of [1, cols] per group into the state at ``path``; those of ``periods`` are replaced and only their rows are
    read. Without ``periods`` all periods that ``df`` has are replaced. Rows with a null in ``cols`` are left out."""
    group, periods = list(group), None if periods is None else list(periods)
    rows = df if periods is None else of_periods(df, period, periods)
    found = factors(rows, [*group, period], cols).select(*group, "n", "r", period)
    if periods is not None:
        kind = df.schema[period].dataType
        empty = df.sparkSession.createDataFrame([(p,) for p in periods], T.StructType([T.StructField(period, kind)]))
        found = found.unionByName(empty.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    # as many rows as groups and periods; those of one period lie in few files
    found.repartition(period, F.pmod(F.xxhash64(*group), F.lit(8)) if group else F.lit(0)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def read(spark: SparkSession, path: str, group_schema: str, period: str, kind: str) -> DataFrame:
    """group, n, r and period of the state; no rows if nothing was stored."""
    schema = ", ".join([s for s in (group_schema, "n long, r array<double>", f"`{period}` {kind}") if s])
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.where(F.col("n") > 0)


def merged(stored: DataFrame, group) -> DataFrame:
    """n and r per group over all rows of ``stored``; filter it by period before for part of the time. The periods of a group are
    stacked in shares first, so no task holds more than a part of them."""
    return stacked(stored.withColumn("_share", F.pmod(F.xxhash64(*[c for c in stored.columns if c != "r"]), F.lit(32))), group)


def moments(stats: DataFrame, group, k: int) -> DataFrame:
    """n, means and covariances (row by row; NULL for one row) of the ``k`` columns behind the triangles."""

    @pandas_udf("mean array<double>, cov array<double>")
    def solve(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for count, flat in zip(n, r, strict=True):
            full = triangle(np.asarray(flat, float).reshape(k + 1, k + 1))
            about = full[1:, 1:]  # the part that the constant does not explain
            cov = (about.T @ about / (count - 1)).ravel().tolist() if count > 1 else [None] * k * k
            out.append(((full[0, 1:] / full[0, 0]).tolist(), cov))
        return pd.DataFrame(out, columns=["mean", "cov"])

    solve = solve.asNondeterministic()  # runs once for both columns
    return stats.select(*group, "n", solve("n", "r").alias("m")).select(*group, "n", "m.*")

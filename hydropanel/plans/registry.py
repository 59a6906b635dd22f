"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydropanel.plans import oracle
from hydropanel.plans.panels import Panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles=(), more: dict[str, str] | None = None, digits: int = 6):
    """Register ``fn(panel)``; real columns are rounded alike on both sides."""
    doubles = doubles.split() if isinstance(doubles, str) else list(doubles)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Panel(spark, sf_dir))
            return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle.sql(sql, doubles, more, digits)
        return fn

    return wrap

"""Sinks: executors write their own part files, nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydropanel import session


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def checkpoint_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    The written table cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or session.fresh_path(spark, "stage")
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def flatten_export(df: DataFrame, array_col: str, path: str | None = None) -> DataFrame:
    """One row per element of an array of structs; written as CSV when a path is given."""
    keep = [c for c in df.columns if c != array_col]
    flat = df.select(*keep, F.inline(array_col))
    if path is not None:
        write_csv(flat, path)
    return flat

"""Table scans.

Every scan selects its columns first, so only those are read, and leaves filters
to the caller: Spark pushes them into the Parquet scan and into the partition
folders.  Station ids are read as text, which keeps their leading zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

RING = "array<struct<lon:double,lat:double>>"


def read_table(spark: SparkSession, path, schema: StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by suffix or ``fmt``; CSV needs its schema, nothing is inferred."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("csv" if paths[0].rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        return reader.option("header", True).option("enforceSchema", False).csv(paths)
    return reader.format(fmt).load(paths)


def annual_flow(spark: SparkSession, path: str) -> DataFrame:
    """Mean flow per station and water year."""
    return read_table(spark, path).select(
        F.col("site_no").cast("string").alias("site_no"),
        F.col("year_nu").cast("int").alias("year_nu"),
        F.col("mean_va").cast("double").alias("mean_va"),
    )


def monthly_flow(spark: SparkSession, path: str) -> DataFrame:
    """Mean flow per station, calendar year and month."""
    return read_table(spark, path).select(
        F.col("site_no").cast("string").alias("site_no"),
        F.col("year_nu").cast("int").alias("year_nu"),
        F.col("month_nu").cast("int").alias("month_nu"),
        F.col("mean_va").cast("double").alias("mean_va"),
    )


def daily_flow(spark: SparkSession, path: str, agency: str | None = None) -> DataFrame:
    """Daily values of all stations: one directory scan, partitioned by ``agency``."""
    df = read_table(spark, path)
    if agency is not None:
        df = df.filter(F.col("agency") == agency)  # prunes folders
    return df.select(
        F.col("agency").cast("string").alias("agency"),
        F.col("site_number").cast("string").alias("site_number"),
        F.to_date("date").alias("date"),
        F.col("value").cast("double").alias("value"),
    )


def station_meta(spark: SparkSession, path: str) -> DataFrame:
    """Station attributes: regulation flag, data type and record range."""
    return read_table(spark, path).select(
        F.col("STATION_NUMBER").cast("string").alias("STATION_NUMBER"),
        F.col("DATA_TYPE").cast("string").alias("DATA_TYPE"),
        F.col("REGULATED").cast("boolean").alias("REGULATED"),
        F.col("Year_from").cast("int").alias("Year_from"),
        F.col("Year_to").cast("int").alias("Year_to"),
    )


def grid_cells(spark: SparkSession, path: str, var: str | None = None) -> DataFrame:
    """Gridded climate in long form ``(cell_id, lon, lat, time, var, value)``."""
    df = read_table(spark, path)
    if var is not None:
        df = df.filter(F.col("var") == var)
    return df.select("cell_id", "lon", "lat", "time", "var", "value")


def polygons(spark: SparkSession, paths, renames: list[dict[str, str]] | None = None) -> DataFrame:
    """Watershed rings of one or more agencies, each with its own column names.

    ``ring`` is one ring or an array of rings (parts and holes), alike in all files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    renames = renames or [{} for _ in paths]
    tables = [read_table(spark, p).withColumnsRenamed(r) for p, r in zip(paths, renames, strict=True)]

    def shape(table: DataFrame) -> str:
        return f"array<{RING}>" if isinstance(table.schema["ring"].dataType.elementType, ArrayType) else RING

    parts = [t.select("identifier", "name", F.col("ring").cast(shape(t)).alias("ring")) for t in tables]
    return reduce(DataFrame.unionByName, parts)

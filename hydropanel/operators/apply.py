"""Extension points for user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_apply(df: DataFrame, keys, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's pandas function per group.

    Spark hands a whole group to the function, so it is for groups of bounded size
    (a region's yearly rows, say); reduce the rows first.  The package's own
    operators use built-in aggregates instead.  ``group_stream`` has no such bound.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def group_stream(
    df: DataFrame,
    keys,
    fn: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    order=(),
) -> DataFrame:
    """A user's function per group that is handed batch by batch, rows by ``order``.

    ``fn`` gets the key's values and an iterator of record batches and yields batches, so a group may be larger than the
    memory of a worker. One shuffle by the keys; a sort by keys and order spills to disk and serves the grouping too.
    Rows that agree in ``order`` come in any order. Null keys are a group; an empty table has no groups. Of a batch of
    the result, columns are taken by name.
    """
    keys = list(keys)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(tuple(k.as_py() for k in key), batches)

    # annotations as objects: Spark tells the streamed form from them
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.groupBy(*keys).applyInArrow(run, schema)


def map_collection(df: DataFrame, items, name: str, result) -> DataFrame:
    """A column function for every row and every item, nested results flattened.

    ``items`` is an array column; ``result`` maps the item column to a struct.
    """
    others = [c for c in df.columns]
    mapped = df.withColumn(name, F.transform(items, result))
    return mapped.select(*others, F.inline(name))

"""Triangular factors of grouped tables: the R of a QR decomposition, from one pass and merged in the shuffle.

The factor of [1, columns] has all that a regression needs, and unlike sums of squares it does not square the condition of the
predictors. A task folds its rows batch by batch into one small triangle per group; triangles are stacked and decomposed again, first within
shares of the tasks and then per group, so no task holds more than a part of them. The result does not depend on means or on the
order of rows beyond rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel.operators.rows import complete

# Groups whose triangles a task holds before it sends them on.
HELD = 20_000
_SHARES = 32


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of some rows, as many rows as columns, with a non-negative diagonal."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) > 1 else rows
    r = np.vstack([r, np.zeros((max(0, width - len(r)), width))])[:width]
    return np.triu(r) * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _square(flat) -> np.ndarray:
    return np.asarray(flat, float).reshape(math.isqrt(len(flat)), -1)


def _codes(batch: pa.RecordBatch, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's group, and a row of each group."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in range(len(group)):
        part = batch.column(k).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def factors(df: DataFrame, group, cols) -> DataFrame:
    """Per group the number of rows ``n`` and ``r``, the triangle of [1, cols] row by row. Rows with a null in any column are left out."""
    group, cols = list(group), list(cols)
    width = len(cols) + 1
    narrow = complete(df.select(*group, *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(cols)]), [f"_v{k}" for k in range(len(cols))])
    schema = T.StructType([narrow.schema[c] for c in group] + T._parse_datatype_string("n long, r array<double>").fields)
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            columns = [*zip(*held, strict=True)] if group else []
            found = [pa.array(c, arrow.field(k).type) for k, c in enumerate(columns)]
            found += [pa.array([n for n, _ in held.values()], pa.int64()), pa.array([r.ravel() for _, r in held.values()], pa.list_(pa.float64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(found, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([np.ones(batch.num_rows), *[batch.column(len(group) + k).to_numpy(zero_copy_only=False) for k in range(len(cols))]])
            code, first = _codes(batch, group)
            names = list(zip(*[batch.column(k).take(pa.array(first)).to_pylist() for k in range(len(group))], strict=True)) if group else [()]
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(len(first) + 1))
            for name, lo, hi in zip(names, bounds, bounds[1:], strict=False):
                rows, own = values[order[lo:hi]], held.get(name)
                held[name] = [hi - lo + (own[0] if own else 0), triangle(rows if own is None else np.vstack([own[1], rows]))]
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    return stacked(narrow.mapInArrow(fold, schema).withColumn("_share", F.spark_partition_id() % _SHARES), group)


def stacked(parts: DataFrame, group) -> DataFrame:
    """Per group the sum of ``n`` and one triangle of all its ``r``, first within the shares ``_share`` and then of these."""
    group = list(group)

    @pandas_udf("array<double>")
    def merge(stacks: pd.Series) -> pd.Series:
        return pd.Series([triangle(np.concatenate([_square(r) for r in s])).ravel() for s in stacks])

    some = parts.groupBy(*group, "_share").agg(F.sum("n").alias("n"), F.collect_list("r").alias("s")).select(*group, "n", merge("s").alias("r"))
    return some.groupBy(*group).agg(F.sum("n").alias("n"), F.collect_list("r").alias("s")).select(*group, "n", merge("s").alias("r"))

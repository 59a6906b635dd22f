"""Helpers the text operators share: tables, row-wise Arrow functions, written stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hydropanel import session

# Rows of one Arrow batch. A batch of documents is then a few MB, so a Python worker
# holds little at once even when some documents are very long.
BATCH_ROWS = 512


def start(spark: SparkSession) -> SparkSession:
    session.prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps do not
    depend on executors that may be lost."""
    spark = df.sparkSession
    path = session.fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rowwise(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict], added: str, keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from Arrow batches of ``columns``.

    ``fn`` returns one list or array per field of the DDL string ``added``. The result has the
    columns ``keep`` of the input, by default ``columns``, followed by the added ones; an input
    column with the name of an added one is left out.
    """
    extra = T._parse_datatype_string(added)
    keep = [c for c in (columns if keep is None else keep) if c not in extra.fieldNames()]
    taken = list(dict.fromkeys([*columns, *keep]))
    narrow = df.select(*[F.col(f"`{c}`") for c in taken])
    schema = T.StructType([narrow.schema[c] for c in keep] + extra.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for f in extra.fields:
                v = out[f.name]
                arrays.append(v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(f.name).type))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *extra.fieldNames()])

    return narrow.mapInArrow(run, schema)


def only_rows(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows for which ``fn`` (a boolean array over the named columns) is true, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(fn(batch), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Whole texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The same as UTF-8."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def fresh_name(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks_for(df: DataFrame) -> int:
    """Partitions for a shuffle whose rows are then held by Python workers."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finalizer, applied to unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def pieces(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows with about ``most`` characters each, so that long texts are not all held at once."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)

"""Session settings the operators rely on, and the shared folder for written stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution splits hot join keys at run time and sizes reduce partitions
# from what was really written, so no operator hard-codes a partition count.
# Nested folders of a directory scan are still pruned by their partition columns.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even when the operator above must then shuffle once more
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

_local_folder: str | None = None
_stages: list[str] = []
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; safe to call repeatedly."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    The archive is the driver's own file; Spark's file server hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="hydropanel-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/hydropanel", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a folder of this machine.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="hydropanel-")
        warnings.warn(f"spark.checkpoint.dir is not set, stages are written to {_local_folder}", stacklevel=2)
    return _local_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    _stages.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _stages[-1]


def release(spark: SparkSession) -> None:
    """Delete the stages this application has written. Frames that read them cannot be used afterwards."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _stages:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stages.pop())
        path.getFileSystem(conf).delete(path, True)

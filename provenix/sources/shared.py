"""The folder that the driver and all executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share; a temporary one only in a local session without such a setting."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{root}/{kind}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread's steps store inside are deleted at its end: a stream that runs for months leaves none behind. What is needed later must be written elsewhere by then."""
    outer, _open.folders = getattr(_open, "folders", None), []
    try:
        yield
    finally:
        for path in _open.folders:
            drop(spark, path)
        _open.folders = outer


def stored(df: DataFrame, kind: str) -> DataFrame:
    """A derived table, written once to the shared folder and read by all that follows from it."""
    at = folder(df.sparkSession, kind)
    if getattr(_open, "folders", None) is not None:
        _open.folders.append(at)
    df.write.parquet(path := f"{at}/table")
    return df.sparkSession.read.parquet(path)


def keep(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this module's when its owner is done with it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

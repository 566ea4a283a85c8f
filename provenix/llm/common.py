"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only if that is unset."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        local = sc.master.startswith("local")
        where = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared checkpoint folder, from where any executor reads them again."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    tidy(out.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Store:
    """Tables of one run in the shared folder: written once, read by all that follows, deleted when done with."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.n = spark, run_folder(spark, kind), 0
        _stores.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(path := f"{self.folder}/{self.n}")
        del df
        tidy(self.spark)
        return self.spark.read.parquet(path)

    def together(self, dfs: Iterable[DataFrame]) -> DataFrame:
        """One table of several of the same columns, each written when those before it are done and their shuffle files are gone."""
        self.n += 1
        top = f"{self.folder}/{self.n}"
        paths = []
        for k, df in enumerate(dfs):
            df.write.option("compression", "zstd").parquet(path := f"{top}/{k}")
            paths.append(path)
            del df
            tidy(self.spark)
        return self.spark.read.parquet(*paths)

    def drop(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_stores: list[Store] = []


def release() -> None:
    """Deletes the tables of all runs so far. For a caller that has written down what it got from them."""
    while _stores:
        _stores.pop().drop()


def run_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about ``most`` bytes of text; one longer text comes alone, whole."""
    for batch in batches:
        at, total, first = batch.schema.get_field_index(column), 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < batch.num_rows:
            yield batch.slice(first)

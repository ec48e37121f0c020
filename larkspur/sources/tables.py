"""Readers of the Parquet tables and the shared working folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes that one task of a sized exchange reads, about; and, where that would make more than MANY tasks, at most.
TASK_BYTES, MOST_BYTES, MANY = 6 << 20, 256 << 20, 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    A local session without that setting is a test; it gets a temporary folder.
    On a cluster the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as the JVM has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    system, at = _system(spark, path)
    system.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    system, at = _system(spark, path)
    system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, upon which executors remove the files of exchanges that no plan refers to."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, and outlives executors.

    The table lasts until the application ends; loops use Rounds, which keeps the last only.
    """
    path = scratch(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class Rounds:
    """The tables of a loop: each round is written and the one before the last is removed."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.path = spark, what, ""

    def next(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, scratch(self.spark, self.what)
        schema = df.schema
        df.write.parquet(self.path)
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(schema).parquet(self.path)


def spread(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Partitions for an exchange of so many rows: the session's number, or more where tasks would read too much."""
    size = rows * row_bytes
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(size / TASK_BYTES), MANY), math.ceil(size / MOST_BYTES))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

"""Writers: sharded tables, versioned snapshots and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.sketch import shard


def write_sharded(df: DataFrame, path: str, term: str, order: list[str], shards: int = 32, kind: str = "parquet") -> None:
    """The rows by shard of a term, each shard in the order, in a folder a shard: a reader of one term reads one folder."""
    df.withColumn("shard", shard(F.col(term), shards)).repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").format(kind).save(path)


def read_shard(spark: SparkSession, path: str, terms: list[str], term: str, shards: int = 32) -> DataFrame:
    """The rows of the terms; only their shards' folders are read."""
    import zlib

    wanted = sorted({zlib.crc32(t.encode()) % shards for t in terms})
    return spark.read.parquet(path).where(F.col("shard").isin(wanted) & F.col(term).isin(terms)).drop("shard")


class Versions:
    """Snapshots of a table, one folder each, and a table of their names whose last row counts.

    A version is readable once its row is there, so readers never see half a
    version; an interrupted write leaves a folder that nothing names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        try:
            rows = self.spark.read.schema("n bigint, version string").parquet(f"{self.path}/versions").orderBy("n").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return [r.version for r in rows]

    def publish(self, df: DataFrame, version: str) -> None:
        before = self.names()
        if version in before:
            raise ValueError(f"there is a version {version} already")
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        self.spark.createDataFrame([(len(before), version)], "n bigint, version string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def current(self) -> DataFrame:
        names = self.names()
        if not names:
            raise ValueError("nothing has been published")
        return self.spark.read.parquet(f"{self.path}/version={names[-1]}")


def export_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV with a header; lists are joined by the separator."""
    columns = [F.concat_ws(separator, c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_text(df: DataFrame, path: str, line: Column) -> None:
    """One line of text a row."""
    df.select(line.cast("string").alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def chosen(df: DataFrame, include: list[str]) -> DataFrame:
    """The columns asked for that there are; all columns if none of them is."""
    known = [c for c in dict.fromkeys(include) if c in df.columns]
    return df.select(*known) if known else df


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)

"""Structured Streaming jobs: windowed counts, deduplication, versions and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators import merge
from larkspur.sources.tables import empty, exists, scratch


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    folder = folder.rstrip("/")
    batch = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    # A table in one file is found by its name in the folder; a stream's path must be a folder.
    if any(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()[:1]):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def windowed_counts(events: DataFrame, moment: str, keys: list[str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each tumbling window and key; rows later than the watermark are dropped."""
    timed = events.withColumn("_at", F.col(moment).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_of_digest(rows: DataFrame, moment: str, digest: Column, late: str = "30 days") -> DataFrame:
    """The first row of each digest within the watermark."""
    timed = rows.withColumn("_at", F.col(moment).cast("timestamp")).withWatermark("_at", late)
    return timed.withColumn("_digest", digest).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest", "_at")


def versions(rows: DataFrame, key: str, moment: str, digest: str) -> DataFrame:
    """A row (key, revision, digest) each time the digest of a key changes; rows of one batch are taken in order of the moment.

    State is the last digest and the number of versions of each key. A key's
    rows of one batch come in parts of bounded size; only their moments and
    digests are held, to be ordered.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        out = []
        held = sorted({(at, value) for part in batches for at, value in zip(part[moment], part[digest])})
        for _, value in held:
            if n == 0 or value != last:
                last, n = value, n + 1
                out.append((k[0], n, value))
        state.update((last, n))
        yield pd.DataFrame(out, columns=[key, "revision", "digest"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, revision bigint, digest string", "last string, n bigint", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a table of the shared folder, and reads that."""
    spark = stream.sparkSession
    path = scratch(spark, what)
    if mode == "append":
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def put(batch: DataFrame, _: int) -> None:
        # The whole result so far takes the place of the one before.
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if exists(spark, path) else empty(spark, stream.schema)


def to_snapshot(stream: DataFrame, keys: list[str], order: list[Column], what: str) -> DataFrame:
    """Runs a stream over what is there now and keeps the last row of each key, a snapshot folder a batch.

    Each batch is merged with the snapshot before it and written as a new
    version; a batch that is run again writes its own version again.
    """
    spark = stream.sparkSession
    path = scratch(spark, what)
    schema, done = stream.schema, []

    def put(batch: DataFrame, number: int) -> None:
        fresh = merge.first_wins(batch, keys, order).select(*schema.names)
        before = f"{path}/version={number - 1}"
        whole = merge.upsert(batch.sparkSession.read.schema(schema).parquet(before), fresh, keys) if number else fresh
        whole.write.mode("overwrite").parquet(f"{path}/version={number}")
        done.append(number)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/version={max(done)}") if done else spark.createDataFrame([], schema)

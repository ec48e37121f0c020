"""State of a crawler: its history, its queue and the caches of searches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.sources.tables import exists


def upgraded(entries: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Entries of an older form in the present one: columns that are missing or null get their defaults."""
    return entries.withColumns({c: F.coalesce(F.col(c), value) if c in entries.columns else value for c, value in defaults.items()})


def registered_digests(entries: DataFrame, url: str, digest: str, moment: str) -> DataFrame:
    """Columns digest, url: the entry that first had each content digest; blank digests are left out."""
    first = F.min(F.struct(F.col(moment), F.col(url).alias("url")))
    return entries.where(F.trim(tx.text_of(F.col(digest))) != "").groupBy(F.col(digest).alias("digest")).agg(first.alias("f")).select("digest", "f.url")


def newest(history: DataFrame, moment: str, tie: str, keep: int = 50) -> DataFrame:
    """The newest entries of a history, by which its size is bounded; null moments are the oldest."""
    return history.orderBy(F.desc_nulls_last(moment), tie).limit(keep)


def queue(entries: DataFrame, key: Column, due: str, priority: str, queued: str, keep: int = 300) -> DataFrame:
    """A queue with one entry a key, the first queued: first due, then by priority to four places, then first queued; with its place, at most so many.

    Null due dates are due at once; the bound is the queue's size.
    """
    first = Window.partitionBy("_key").orderBy(queued, due)
    once = entries.withColumn("_key", key).where("_key IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = [F.asc_nulls_first(due), F.desc_nulls_last(F.round(F.col(priority), 4)), F.col(queued), F.col("_key")]
    best = once.orderBy(*order).limit(keep)
    # At most `keep` rows are numbered in one place.
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumnRenamed("_key", "key")


def stale(sources: DataFrame, fetched: str, as_of: str, hours: int = 168) -> Column:
    """Whether a source was fetched longer ago than so many hours, or never."""
    age = F.timestamp_diff("SECOND", F.col(fetched).cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return F.col(fetched).isNull() | (age > hours * 3600)


def rebuilt(sources: DataFrame, status: str, fetched: str, as_of: str, hours: int = 168) -> DataFrame:
    """The sources a full rebuild goes over, with what happens to each: kept, fetched again when stale; failed and inactive ones are pruned."""
    action = F.when(F.lower(F.coalesce(F.col(status), F.lit("active"))) != "active", "pruned").when(stale(sources, fetched, as_of, hours), "fetched").otherwise("kept")
    return sources.withColumn("action", action)


class SearchCache:
    """Results of searches in a folder, by a digest of query, limit and filters; the newest entries, while they live."""

    _SCHEMA = "fingerprint string, stored_at timestamp_ntz, payload string"

    def __init__(self, spark: SparkSession, path: str, most: int = 120):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    @staticmethod
    def fingerprint(query: str, filters: dict, limit: int) -> str:
        return hashlib.sha256(f"{query.strip()}|{limit}|{json.dumps(filters, sort_keys=True, ensure_ascii=False)}".encode()).hexdigest()

    def entries(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self._SCHEMA)
        rows = self.spark.read.schema(self._SCHEMA).json(self.path)
        last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("stored_at")))).where("_n = 1").drop("_n")
        return last.orderBy(F.desc("stored_at"), "fingerprint").limit(self.most)

    def store(self, fingerprint: str, payload: str, stored_at: str) -> None:
        row = self.spark.createDataFrame([(fingerprint, stored_at, payload)], "fingerprint string, stored_at string, payload string")
        row.withColumn("stored_at", F.col("stored_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").json(self.path)

    def fetch(self, fingerprint: str, as_of: str, minutes: int = 1440) -> str | None:
        age = F.timestamp_diff("SECOND", F.col("stored_at").cast("timestamp"), F.lit(as_of).cast("timestamp"))
        found = self.entries().where((F.col("fingerprint") == fingerprint) & (age <= minutes * 60)).first()
        return found["payload"] if found else None

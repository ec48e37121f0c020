"""Queries over streams, each run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.plans.registry import Registry
from larkspur.streaming import jobs

R = Registry()


@R.add("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each day and type, with a watermark late enough for all of them."""
    counts = jobs.windowed_counts(jobs.stream_of(spark, folder, "events"), "ts", ["event_type"], late="60 days")
    return jobs.to_table(counts, "event-counts", "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@R.add("SELECT count(DISTINCT lower(trim(title))) AS titles FROM market_news WHERE trim(title) <> ''")
def stream_distinct_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that first come in a stream, counted."""
    news = jobs.stream_of(spark, folder, "market_news").where(F.trim("title") != "")
    first = jobs.first_of_digest(news.select("news_id", "received_at", "title"), "received_at", F.lower(F.trim("title")), late="2000 days")
    return jobs.to_table(first, "first").agg(F.count("*").alias("titles"))


@R.add("""WITH v AS (SELECT lower(trim(source)) AS source, md5(coalesce(title, '')) AS d, row_number() OVER w AS n, lag(md5(coalesce(title, ''))) OVER w AS before FROM market_news WHERE trim(source) <> '' WINDOW w AS (PARTITION BY lower(trim(source)) ORDER BY received_at, md5(coalesce(title, ''))))
SELECT source, count(*) AS revisions FROM v WHERE before IS NULL OR before <> d GROUP BY source""")
def stream_versions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source's latest title changes, by keyed state."""
    news = jobs.stream_of(spark, folder, "market_news").where(F.trim("source") != "")
    rows = news.select(F.lower(F.trim("source")).alias("source"), F.col("received_at").alias("at"), F.md5(tx.text_of(F.col("title"))).alias("digest"))
    found = jobs.to_table(jobs.versions(rows, "source", "at", "digest"), "versions")
    return found.groupBy("source").agg(F.max("revision").alias("revisions"))


@R.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) * 0 + arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user, kept as a versioned snapshot."""
    events = jobs.stream_of(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    micros = -F.unix_micros(F.col("ts").cast("timestamp"))
    return jobs.to_snapshot(events, ["user_id"], [micros, -F.col("event_id")], "latest").select("user_id", "event_type", "event_id")

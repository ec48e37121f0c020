"""Timestamps of mixed formats and zones, normalised to one UTC instant.

Method: the distinct (text, home zone, date order) triples form a dictionary.
Each is parsed once, by every rule of functions.instants; the dictionary is a
table that grows by the values it lacks, and the instants are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.instants import parse
from larkspur.sources.tables import scratch, table

KEY = ["_raw", "_home", "_order"]
#: Setting of the session that names a lasting folder for the dictionary of p3_found(); without it a run has its own.
DICTIONARY = "spark.larkspur.instants"
_DICTIONARY = T.StructType([T.StructField(k, T.StringType()) for k in KEY] + [T.StructField("_epoch_us", T.LongType())])


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, homes, orders = (batch[k].tolist() for k in KEY)
        batch["_epoch_us"] = pd.array([parse(t, h or None, o or None) for t, h, o in zip(texts, homes, orders)], dtype="Int64")
        yield batch


class InstantDictionary:
    """A persistent table of parsed timestamp texts, in a folder all executors share.

    update() parses what the dictionary lacks and appends it; a text that an
    earlier batch brought is never parsed again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path, 0

    def entries(self) -> DataFrame:
        """All entries so far, each once, whoever wrote it twice; empty before the first update."""
        try:
            return self.spark.read.schema(_DICTIONARY).parquet(self.path).groupBy(*KEY).agg(F.first("_epoch_us").alias("_epoch_us"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _DICTIONARY)

    def update(self, keys: DataFrame) -> None:
        """keys: columns _raw, _home and _order, repeated at will."""
        new = keys.select(*KEY).where(F.col("_raw").isNotNull()).distinct()
        new = new.join(self.entries().select(*KEY), KEY, "left_anti")
        new.mapInPandas(_parse_batches, _DICTIONARY).write.mode("append").parquet(self.path)


def source_rules(sources: DataFrame) -> DataFrame:
    """One row per written form of a source: its key, home zone and date order.

    A form is the name or an alias, lower-cased and trimmed. Of several sources
    that share a form the smallest source_id counts. Null and blank forms are
    left out.
    """
    forms = sources.select("source_id", "home_tz", "date_order", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return (
        forms.withColumn("_form", F.lower(F.trim("form"))).where("_form <> ''")
        .groupBy("_form").agg(F.min_by(F.struct(F.coalesce("home_tz", F.lit("")).alias("_home"), F.coalesce("date_order", F.lit("")).alias("_order")), "source_id").alias("_r"))
        .select("_form", "_r._home", "_r._order")
    )


def normalise_timestamps(df: DataFrame, text: str, source: str, sources: DataFrame, dictionary: InstantDictionary, out: str = "epoch_us", source_forms_bounded: bool = True) -> DataFrame:
    """df with a column out: the microseconds since 1970-01-01 UTC that the text denotes, or null.

    text and source are columns of df; sources is the table of sources. Null,
    blank and unparsable texts give null; so do readings that need a source
    that matches none. Rows that repeat stay repeated, an empty df gives an
    empty result, further columns stay whatever their names (but for the
    underscored names used here, and out).
    """
    rules = source_rules(sources)
    # The table of sources is fixed by the data model; it is hinted only where the caller vouches for that.
    rules = F.broadcast(rules) if source_forms_bounded else rules
    keyed = with_source_rules(df, text, source, rules)
    dictionary.update(keyed)
    entries = dictionary.entries()
    return keyed.join(entries, KEY, "left").withColumnRenamed("_epoch_us", out).drop(*KEY)


def with_source_rules(df: DataFrame, text: str, source: str, rules: DataFrame) -> DataFrame:
    def lowered(c: Column) -> Column:
        return F.lower(F.trim(c))

    return (
        df.withColumn("_form", lowered(F.col(source))).join(rules, "_form", "left").drop("_form")
        .withColumn("_raw", F.col(text)).withColumn("_home", F.coalesce("_home", F.lit(""))).withColumn("_order", F.coalesce("_order", F.lit("")))
    )


# Table, its id and its timestamp text.
RECORDS = [("raw_articles", "id", "ts"), ("market_news", "news_id", "published_at"), ("sentiment_articles", "article_id", "published_at")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of the three tables whose text denotes exactly one instant.

    Records delivered twice give one row; a record whose deliveries differ
    gives a row for each instant. Where the session's setting DICTIONARY names
    a folder, the dictionary stays there, and a later run parses only texts
    that are new to it.
    """
    records = None
    for name, key, text in RECORDS:
        part = table(spark, folder, name).select(F.lit(name).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text"), "source")
        records = part if records is None else records.unionByName(part)
    dictionary = InstantDictionary(spark, spark.conf.get(DICTIONARY, None) or scratch(spark, "instants"))
    found = normalise_timestamps(records, "text", "source", table(spark, folder, "news_sources"), dictionary)
    return found.where(F.col("epoch_us").isNotNull()).select("src", "rec_id", "epoch_us").distinct()

"""Near-duplicate records: pairs, links and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import wordsets
from larkspur.sources.tables import table, written

TEXTS = ["title", "lede"]


def similar_pairs(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Columns id_a < id_b: every pair of records whose word sets have a similarity of 0.65 or more.

    Null texts count as empty; a record without words is in no pair. Rows that
    repeat a key give one record per different text. Copies are expanded into
    all their pairs; duplicate_classes() gives classes and their links instead.
    """
    classes = written(wordsets.members(df, key, texts), "members")
    pairs = written(wordsets.class_pairs(df, texts), "class-pairs")
    return expanded(classes, pairs)


def expanded(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids from the members (id, h) of classes and the linked classes (h_a, h_b)."""
    linked = (
        pairs.join(classes.select(F.col("h").alias("h_a"), F.col("id").alias("_x")), "h_a")
        .join(classes.select(F.col("h").alias("h_b"), F.col("id").alias("_y")), "h_b")
        .select("_x", "_y")
    )
    several = classes.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
    copies = classes.join(several, "h")
    same = copies.select("h", F.col("id").alias("_x")).join(copies.select("h", F.col("id").alias("_y")), "h").where("_x < _y").select("_x", "_y")
    both = linked.unionByName(same).where("_x <> _y")
    return both.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "raw_articles"), "id", TEXTS)


def duplicate_classes(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """One row per record with words: id, class_id (the smallest id with its word set), size (records of the class), links (other classes similar to it).

    Copies are not expanded: the rows and the links together hold every pair.
    """
    classes = written(wordsets.members(df, key, texts), "members")
    pairs = written(wordsets.class_pairs(df, texts), "class-pairs")
    links = pairs.select(F.col("h_a").alias("h")).unionAll(pairs.select(F.col("h_b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    named = classes.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    return classes.join(named.join(links, "h", "left"), "h").select("id", "class_id", "size", F.coalesce("links", F.lit(0)).alias("links"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_classes(table(spark, folder, "raw_articles"), "id", TEXTS)

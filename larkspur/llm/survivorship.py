"""The best value of each field in every group of duplicate records.

Method: field-by-field survivorship. One aggregation takes, for each group and
field, the maximum of the composite (completeness, trust, time, smaller id)
over the usable values, beside the maxima of trust and time alone; where the
composite's own trust and time equal those, its record is best in all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import wordsets
from larkspur.llm.components import connected_components
from larkspur.llm.near_duplicates import TEXTS
from larkspur.sources.tables import table, written


def groups(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Columns id and group_id (the group's smallest id) of each record that is similar to another.

    Groups are the connected sets of records linked by a similarity of 0.65 or
    more; classes of equal word sets are linked as one node.
    """
    classes = written(wordsets.members(df, key, texts), "members")
    pairs = wordsets.class_pairs(df, texts)
    roots = connected_components(pairs, "h_a", "h_b")
    sized = classes.join(roots.withColumnRenamed("node", "h"), "h", "left").select("id", F.coalesce("root", "h").alias("_root")).distinct()
    named = sized.groupBy("_root").agg(F.min("id").alias("group_id"), F.count("*").alias("_n")).where("_n > 1")
    return sized.join(named, "_root").select("id", "group_id")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def source_trust(sources: DataFrame) -> DataFrame:
    """Columns _form (lower-cased and trimmed name or alias) and _trust (0 if null); of sources that share a form the smallest source_id."""
    forms = sources.select("source_id", "trust_score", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return forms.withColumn("_form", F.lower(F.trim("form"))).where("_form <> ''").groupBy("_form").agg(F.min_by(F.coalesce("trust_score", F.lit(0.0)), "source_id").alias("_trust"))


def survivors(records: DataFrame, group: str, key: str, time: str, fields: dict[str, tuple[Column, Column]], trust: Column) -> DataFrame:
    """One row per group and field with a usable value.

    fields: name -> (completeness, value); a value whose completeness is null
    or not positive is unusable. Columns: group, field_name, id (the record
    whose value is most complete, of equals the most trusted, then the latest,
    then the smallest key), value, best_in_all (whether no other usable value
    is more trusted or later). A null time is the earliest. Ties, repeated
    records and empty tables need no care of the caller.
    """
    late = F.coalesce(F.col(time).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    parts = F.array(*[F.struct(F.lit(name).alias("field_name"), full.cast("bigint").alias("full"), value.cast("string").alias("value")) for name, (full, value) in fields.items()])
    each = records.select(F.col(group).alias("_g"), F.col(key).alias("_id"), late.alias("_late"), trust.alias("_trust"), F.explode(parts).alias("_p")).where("_p.full > 0")
    best = F.max(F.struct(F.col("_p.full").alias("full"), F.col("_trust").alias("trust"), F.col("_late").alias("late"), (-F.col("_id")).alias("minus"), F.col("_p.value").alias("value")))
    found = each.groupBy("_g", "_p.field_name").agg(best.alias("b"), F.max("_trust").alias("_t"), F.max("_late").alias("_l"))
    return found.select(F.col("_g").alias(group), "field_name", (-F.col("b.minus")).alias("id"), "b.value", ((F.col("b.trust") == F.col("_t")) & (F.col("b.late") == F.col("_l"))).alias("best_in_all"))


def article_survivors(spark: SparkSession, folder: str, values: bool = True) -> DataFrame:
    """survivors() of the groups of similar raw articles."""
    articles = table(spark, folder, "raw_articles")
    member = written(groups(articles, "id", TEXTS), "groups")
    entities = F.array_distinct(F.filter(F.transform("entities", lambda e: F.lower(stripped(e))), lambda e: e != ""))
    kept = {c: F.col(c) if values else F.lit(None).cast("string") for c in ("title", "lede", "source")}
    measured = (
        articles.withColumn("_form", F.lower(F.trim("source")))
        # The table of sources is fixed by the data model.
        .join(F.broadcast(source_trust(table(spark, folder, "news_sources"))), "_form", "left")
        .select("id", "received_at", F.coalesce("_trust", F.lit(0.0)).alias("trust"), F.col("_trust").isNotNull().cast("int").alias("n_source"), F.length(stripped(F.col("title"))).alias("n_title"), F.length(stripped(F.col("lede"))).alias("n_lede"), F.size(entities).alias("n_entities"), *[v.alias(f"v_{c}") for c, v in kept.items()], (F.to_json("entities") if values else F.lit(None).cast("string")).alias("v_entities"))
    )
    fields = {f: (F.col(f"n_{f}"), F.col(f"v_{f}")) for f in ("title", "lede", "source", "entities")}
    return survivors(measured.join(member, "id"), "group_id", "id", "received_at", fields, F.col("trust"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return article_survivors(spark, folder, values=False).where("best_in_all").select("group_id", "field_name", "id")


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving article per group, each field's value the most complete, then the most trusted, then the latest."""
    parts = article_survivors(spark, folder)
    return parts.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in ("title", "lede", "source", "entities")])

"""Queries of the relations that documents state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.relations import ALIAS, ALSO, IS_A, LABEL, relations, verb_template
from larkspur.plans.graph_queries import KEY
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table

R = Registry()
VERBS = [verb_template("approved", ["approved"]), verb_template("signed", ["signed"]), verb_template("sold", ["sold"], ["its"])]
SENT = "WITH s AS (SELECT doc_id, trim(s) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\\n\\r]+')) AS s FROM documents))"
RULES = [IS_A, ALSO, LABEL, *VERBS]


def _one(pattern: str, group: int, of: str = "s") -> str:
    return KEY.format(f"regexp_extract({of}, '{pattern}', {group})").replace("\\s+", "[ \\t\\n\\x0B\\f\\r]+")


def _sql() -> str:
    """Aliases in brackets besides, and of the rules the first that matches."""
    cases = " ".join(f"WHEN regexp_matches(s, '{p}') THEN {{'subject': {_one(p, 1)}, 'relation': '{r}', 'object': {_one(p, 2)}}}" for p, r, _ in RULES)
    first = f"SELECT doc_id, CASE {cases} END AS t FROM s"
    besides = f"SELECT doc_id, {{'subject': {_one(ALIAS, 1, 'm')}, 'relation': 'synonym', 'object': {_one(ALIAS, 2, 'm')}}} AS t FROM (SELECT doc_id, unnest(regexp_extract_all(s, '{ALIAS}', 0)) AS m FROM s)"
    return SENT + f", t AS ({first} UNION ALL {besides}), e AS (SELECT doc_id, t.subject AS subject, t.relation AS relation, t.object AS object FROM t WHERE t IS NOT NULL), k AS (SELECT * FROM e WHERE subject <> '' AND object <> '' AND subject <> object AND len(string_split(subject, ' ')) <= 8 AND len(string_split(object, ' ')) <= 12 AND strlen(subject) <= 80 AND strlen(object) <= 120) "


def _found(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "documents").select("doc_id", F.explode(F.split(tx.text_of(F.col("text")), r"[.!?\n\r]+")).alias("s"))
    return relations(said, "s", VERBS)


@R.add(_sql() + "SELECT doc_id, subject, relation, object, count(*) AS n FROM k GROUP BY ALL")
def stated_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).groupBy("doc_id", "subject", "relation", "object").agg(F.count("*").alias("n"))


@R.add(_sql() + "SELECT relation, count(*) AS n, count(DISTINCT subject) AS subjects FROM k GROUP BY relation")
def stated_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@R.add(_sql() + "SELECT subject, object FROM k WHERE relation = 'isa' GROUP BY 1, 2")
def is_a_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).where("relation = 'isa'").select("subject", "object").distinct()

"""Queries of whole-document profiles, cleaning, word classes, trees and source features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.functions.similarity import metaphone, similar_text
from larkspur.operators import graph
from larkspur.plans.analysis_queries import QUALITY, _quality
from larkspur.plans.graph_queries import DOM, LINKS, _ledger
from larkspur.plans.more_queries import NAVIGATION
from larkspur.plans.registry import Registry
from larkspur.plans.search_queries import AS_OF, minutes_since
from larkspur.sources.tables import table

R = Registry()


def navigation(line: Column) -> Column:
    return line.isin(NAVIGATION) | line.contains(" | ") | ~line.rlike(r"\p{L}")


@R.add(f"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, i, trim(x[i]) AS line FROM l), c AS (SELECT * FROM k WHERE line <> '' AND NOT (list_contains({NAVIGATION!r}, lower(line)) OR contains(lower(line), ' | ') OR NOT regexp_matches(lower(line), '\\p{{L}}')))
SELECT doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM c GROUP BY doc_id""")
def cleaned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without navigation lines, by a digest of what stays."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~navigation(F.lower(x)))
    return table(spark, folder, "documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0).select("doc_id", F.size("l").cast("bigint").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


WORD = "list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+'), lambda x: x <> '')"


@R.add(f"""WITH w AS (SELECT doc_id, {WORD} AS w FROM documents)
SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z]+$'))) AS names, len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{3,}}(?:ed|ing)$'))) AS verbs, len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{2,}}ly$'))) AS adverbs,
len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{2,}}(?:ous|ful|ive|able|al)$'))) AS adjectives FROM w""")
def word_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Words by their form: names, verbs, adverbs and adjectives."""
    w = F.filter(F.split(tx.text_of(F.col("text")), "[^A-Za-z]+"), lambda x: x != "")

    def count(pattern: str) -> Column:
        return F.size(F.filter("w", lambda x: x.rlike(pattern))).cast("bigint")

    return table(spark, folder, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("words"), count("^[A-Z][a-z]+$").alias("names"), count("^[a-z]{3,}(?:ed|ing)$").alias("verbs"), count("^[a-z]{2,}ly$").alias("adverbs"), count("^[a-z]{2,}(?:ous|ful|ive|able|al)$").alias("adjectives"))


@R.add(LINKS + """, c AS (SELECT src, dst, last_seen, row_number() OVER (PARTITION BY src ORDER BY last_seen DESC, dst) AS rank FROM g), s AS (SELECT src FROM (SELECT src, max(last_seen) AS l FROM g GROUP BY src) ORDER BY l DESC, src LIMIT 6)
SELECT src, rank, dst FROM c WHERE rank <= 5 AND src IN (SELECT src FROM s)""")
def discovery_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The six sources seen last, each with its five domains seen last."""
    led = _ledger(spark, folder)
    # A top-k report of six rows.
    seeds = led.groupBy("src").agg(F.max("last_seen").alias("l")).orderBy(F.desc("l"), "src").limit(6).select("src")
    return graph.top_each(led.join(F.broadcast(seeds), "src", "left_semi"), ["src"], [F.desc("last_seen"), F.col("dst")], 5).select("src", "rank", "dst")


@R.add(f"""WITH q AS (SELECT doc_id, {QUALITY} AS s, CASE WHEN trim(coalesce(text, '')) = '' THEN NULL ELSE sha256(text) END AS d FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY doc_id) AS k FROM q)
SELECT doc_id, round(greatest(0.0, s - CASE WHEN d IS NOT NULL AND k > 1 THEN 25 ELSE 0 END), 4) AS quality, d IS NOT NULL AND k > 1 AS duplicate FROM r""")
def duplicate_penalty(spark: SparkSession, folder: str) -> DataFrame:
    """Quality less 25 for every document whose text came before under a smaller id."""
    docs = table(spark, folder, "documents")
    digest = F.when(F.trim(tx.text_of(F.col("text"))) != "", F.sha2("text", 256))
    scored = docs.select("doc_id", _quality().alias("s"), digest.alias("d"))
    first = scored.where("d IS NOT NULL").groupBy("d").agg(F.min("doc_id").alias("first"))
    again = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return scored.join(first, "d", "left").select("doc_id", F.round(F.greatest(F.lit(0.0), F.col("s") - F.when(again, 25).otherwise(0)), 4).alias("quality"), again.alias("duplicate"))


@R.add(f"""WITH a AS (SELECT lower(trim(source)) AS source, exp(-(greatest(0, date_diff('second', received_at, TIMESTAMP '{AS_OF}')) // 60) / 60.0 / 48) AS fresh, {DOM} AS d, len(coalesce(entities, [])) AS e FROM raw_articles WHERE trim(coalesce(source, '')) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY e DESC) AS k FROM a)
SELECT source, round(avg(fresh), 6) AS freshness, round(least(1.0, count(DISTINCT nullif(d, '')) * 1.4 / count(*)), 6)::DOUBLE AS diversity, round(least(1.0, avg(e) FILTER (k <= 3) / 12), 6)::DOUBLE AS density, round(1 - exp(-count(*) / 20.0), 6) AS volume FROM r GROUP BY source""")
def source_features(spark: SparkSession, folder: str) -> DataFrame:
    """Freshness, diversity, density and volume of each source as features within 0 and 1."""
    rows = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("source"))) != "").select(F.lower(F.trim("source")).alias("source"), F.exp(-minutes_since(F.col("received_at")) / 60.0 / 48).alias("f"), urls.domain(F.col("url")).alias("d"), F.size(F.coalesce("entities", F.array().cast("array<string>"))).alias("e"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("e"))))
    n = F.count("*")
    return ranked.groupBy("source").agg(F.round(F.avg("f"), 6).alias("freshness"), F.round(F.least(F.lit(1.0), F.count_distinct(F.when(F.col("d") != "", F.col("d"))) * 1.4 / n), 6).alias("diversity"), F.round(F.least(F.lit(1.0), F.avg(F.when(F.col("k") <= 3, F.col("e"))) / 12), 6).alias("density"), F.round(1 - F.exp(-n / 20.0), 6).alias("volume"))


@R.add("""WITH n AS (SELECT DISTINCT news_id, source, received_at FROM market_news WHERE trim(source) <> ''), s AS (SELECT DISTINCT article_id, source, received_at FROM sentiment_articles WHERE trim(source) <> '')
SELECT n.news_id, (SELECT max(s.received_at) FROM s WHERE lower(trim(s.source)) = lower(trim(n.source)) AND s.received_at <= n.received_at) AS latest FROM n GROUP BY ALL""")
def as_of_latest(spark: SparkSession, folder: str) -> DataFrame:
    """For each news the latest scored article of its source up to its own time, by one sorted pass over both."""
    news = table(spark, folder, "market_news").where(F.trim("source") != "").select("news_id", F.lower(F.trim("source")).alias("s"), "received_at", F.lit(1).alias("o")).distinct()
    scored = table(spark, folder, "sentiment_articles").where(F.trim("source") != "").select(F.lit(None).cast("bigint").alias("news_id"), F.lower(F.trim("source")).alias("s"), "received_at", F.lit(0).alias("o"))
    past = Window.partitionBy("s").orderBy("received_at", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = news.unionByName(scored).withColumn("latest", F.max(F.when(F.col("o") == 0, F.col("received_at"))).over(past))
    return merged.where("o = 1").select("news_id", "latest").distinct()


@R.add("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders), w AS (SELECT a.o_orderkey AS a, count(*) AS near FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderdate BETWEEN a.o_orderdate - INTERVAL 30 DAY AND a.o_orderdate GROUP BY 1)
SELECT near, count(*) AS orders FROM w GROUP BY near""")
def range_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many orders have how many of their customer's within the thirty days up to them, by a range frame in place of a range join."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    frame = Window.partitionBy("o_custkey").orderBy("_at").rangeBetween(-30 * 86400, 0)
    return table(spark, folder, "orders").withColumn("_at", seconds).withColumn("near", F.count("*").over(frame)).groupBy("near").agg(F.count("*").alias("orders"))


@R.add()
def sound_and_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with the sound and likeness of their names to one name; Arrow-batched functions, tested on small texts."""
    return table(spark, folder, "companies").select("symbol", metaphone(F.split("name", " ")[0]).alias("sound"), F.round(similar_text(F.lower("name"), F.lit("holdings")), 4).alias("likeness"))


@R.add()
def paged_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the whole search over all articles; tested against the formula on small tables."""
    from larkspur import api

    trust = table(spark, folder, "news_sources").select(F.col("name").alias("source"), F.col("trust_score").alias("trust"))
    built = api.build_index(table(spark, folder, "raw_articles").withColumn("at", F.col("received_at").cast("timestamp")), trust)
    return api.search(built, 'pension "supply deal" merger', AS_OF)

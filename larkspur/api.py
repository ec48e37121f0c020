"""The search engine as a whole: build an index of articles, keep it, and search it page by page."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.sketch import simhash64, valid_hex16
from larkspur.operators import dedupe, index
from larkspur.sources.sinks import read_shard, write_sharded

# Minutes of each window.
SINCE = {"24h": 1440, "7d": 10080, "30d": 43200}
K1, B = 1.2, 0.75
SHARDS = 32


@dataclass
class Index:
    """Tables of an index: docs (with length, simhash and trust), postings (term, id, wtf) and stats (one row)."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Writes the tables; postings by shard of their term and articles by shard of their id, so that a look-up reads only its shards."""
        self.docs.withColumn("shard", F.pmod("id", F.lit(SHARDS)).cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/docs")
        write_sharded(self.postings, f"{path}/postings", "term", ["term", "id"])
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    def meta(self) -> DataFrame:
        """Columns id, length_norm (.25 + .75 length / mean length) and source_rank (trust) of each article."""
        norm = (1 - B) + B * F.greatest(F.lit(1), F.col("length")) / F.col("avg_length")
        # One row of statistics.
        return self.docs.crossJoin(F.broadcast(self.stats)).select("id", norm.alias("length_norm"), F.col("trust").alias("source_rank"))

    def recency(self, as_of: str) -> DataFrame:
        """Columns id and minutes since the article; null without a time."""
        return self.docs.select("id", minutes(F.col("at"), as_of).alias("minutes"))

    def facets(self, as_of: str) -> DataFrame:
        """Columns facet, value, n: articles by source, by language and in the last day, week and month."""
        age = minutes(F.col("at"), as_of)
        windows = F.array_compact(F.array(*[F.when(age <= m, F.struct(F.lit("date").alias("facet"), F.lit(w).alias("value"))) for w, m in SINCE.items()]))
        kinds = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "lang")])
        return self.docs.select(F.explode(F.concat(kinds, windows)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def minutes(moment: Column, as_of: str) -> Column:
    """Whole minutes from a moment to another, 0 for later ones, null for null."""
    return F.when(moment.isNotNull(), F.floor(F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.date_trunc("second", moment.cast("timestamp")), F.lit(as_of).cast("timestamp"))) / 60))


def build_index(articles: DataFrame, trust: DataFrame | None = None, default_trust: float = 0.6) -> Index:
    """An index of articles: id, at (timestamp), title, lede, url, source, lang, entities, simhash.

    trust has columns source and trust, by lower-cased name. Missing
    fingerprints are computed. Rows with a null id are left out; of rows that
    share an id any one stays.
    """
    rows = articles.where("id IS NOT NULL").dropDuplicates(["id"]).select("id", "at", "title", "lede", "url", "source", F.lower("lang").alias("lang"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), valid_hex16(F.col("simhash")).alias("_s"))
    whole = F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("lede")))
    computed = simhash64(rows.where("_s IS NULL"), "id", tx.index_terms(whole)).withColumnRenamed("simhash", "_c")
    length = F.size(tx.index_terms(F.col("title"))) + F.size(tx.index_terms(F.col("lede")))
    docs = rows.join(computed, "id", "left").withColumn("simhash", F.coalesce("_s", "_c")).withColumn("length", length).drop("_s", "_c")
    if trust is None:
        docs = docs.withColumn("trust", F.lit(default_trust))
    else:
        known = trust.groupBy(F.lower(F.trim("source")).alias("_src")).agg(F.max("trust").alias("_t"))
        docs = docs.join(known, F.lower(F.trim("source")) == F.col("_src"), "left").withColumn("trust", F.coalesce("_t", F.lit(default_trust))).drop("_src", "_t")
    return Index(docs, index.postings(rows, "id", "title", "lede").select("term", "id", "wtf"), index.corpus_stats(docs))


def open_index(spark: SparkSession, path: str, query: str | None = None) -> Index:
    """A saved index; with a query only the shards of its terms."""
    postings = spark.read.parquet(f"{path}/postings").drop("shard") if query is None else read_shard(spark, f"{path}/postings", query_terms(query), "term")
    return Index(spark.read.parquet(f"{path}/docs").drop("shard"), postings, spark.read.parquet(f"{path}/stats"))


def hydrated(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The articles of a saved index with these ids; only their shards are read."""
    wanted = sorted({i % SHARDS for i in ids})
    return spark.read.parquet(f"{path}/docs").where(F.col("shard").isin(wanted) & F.col("id").isin(ids)).drop("shard")


def query_terms(query: str) -> list[str]:
    """Distinct folded terms of a query, without stopwords and single characters, in order."""
    table = str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)
    plain = re.sub(r"[^\x00-\x7f]", "", query.lower().translate(table))
    return [t for t in dict.fromkeys(re.split("[^a-z0-9]+", plain)) if len(t) > 1 and t not in tx.STOPWORDS]


def search(idx: Index, query: str, as_of: str, page: int = 1, since: str = "all", sources: tuple[str, ...] = (), lang: str | None = None, collapse: bool = True, size: int = 20) -> DataFrame:
    """One page of results: id, score, title, url, source, at, snippet.

    The score is BM25 over weighted terms + .2 e^(-minutes / 4320) + .15 trust
    + .05 for each of up to two entities that the query names + .1 if a quoted
    phrase stands in the title or text. Near-duplicates are collapsed
    into the best of them before the page is cut. A query without terms, and
    a page beyond the end, give no rows; ties go to the smaller id.
    """
    terms = query_terms(query)
    if not terms:
        return idx.docs.limit(0).select("id", F.lit(0.0).alias("score"), "title", "url", "source", "at", F.lit("").alias("snippet"))
    hits = idx.postings.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))
    # A row for each of the query's terms, and one of statistics.
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(idx.stats)).join(idx.docs.select("id", F.greatest(F.lit(1), F.col("length")).alias("_n")), "id")
    norm = (1 - B) + B * F.col("_n") / F.col("avg_length")
    one = F.log((F.col("n_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1) * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * norm)
    found = scored.groupBy("id").agg(F.sum(one).alias("_bm25")).join(idx.docs, "id")
    age = minutes(F.col("at"), as_of)
    if since in SINCE:
        found = found.where(age <= SINCE[since])
    if sources:
        found = found.where(F.col("source").isin(list(sources)))
    if lang:
        found = found.where(F.col("lang") == lang.lower())
    low = F.lower(F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("lede"))))
    phrases = [p.strip().lower() for p in re.findall(r'"([^"\n]+)"', query) if p.strip()]
    named = [e.lower() for e in dict.fromkeys(re.findall(r"\b[A-Z][^\W_]+(?:\s+[A-Z][^\W_]+)*", query))]
    entities = F.array_distinct(F.transform("entities", lambda e: F.lower(F.trim(e))))
    shared = F.size(F.array_intersect(entities, F.array(*[F.lit(e) for e in named]).cast("array<string>"))) if named else F.lit(0)
    phrase = F.when(F.greatest(*[low.contains(p) for p in phrases], F.lit(False)), 0.1).otherwise(0.0) if phrases else F.lit(0.0)
    score = F.col("_bm25") + F.coalesce(0.2 * F.exp(-age / 4320.0), F.lit(0.0)) + 0.15 * F.col("trust") + 0.05 * F.least(F.lit(2), shared) + phrase
    found = found.withColumn("score", F.round(score, 6))
    if collapse:
        found = found.join(dedupe.collapsed(found, "id", "score", "simhash").select("id"), "id", "left_semi")
    best = found.orderBy(F.desc("score"), "id").offset((max(1, page) - 1) * size).limit(size)
    return best.select("id", "score", "title", "url", "source", "at", tx.highlighted(tx.snippet(F.col("lede"), terms), terms).alias("snippet"))

"""Queries of the index build and the ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.sketch import content_digest, hamming, simhash64, valid_hex16
from larkspur.operators import dedupe, index
from larkspur.operators.ranking import bm25_scores
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table

R = Registry()
STOP = ", ".join(f"'{w}'" for w in sorted(set(tx.STOPWORDS)))
#: The moment from which ages are counted, in place of a clock.
AS_OF = "2025-04-09 00:00:00"


def sql_terms(column: str) -> str:
    """SQL of the index terms of a column, one a row, before stopwords are left out."""
    return f"unnest(regexp_split_to_array(regexp_replace(translate(lower(coalesce({column}, '')), '{tx.FOLD_FROM}', '{tx.FOLD_TO}'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+'))"


TOKENS = f"""
WITH tok AS (
  SELECT id, term, w FROM (
    SELECT id, {sql_terms('title')} AS term, 3 AS w FROM raw_articles
    UNION ALL SELECT id, {sql_terms('lede')}, 2 FROM raw_articles)
  WHERE length(term) > 1 AND term NOT IN ({STOP})),
post AS (SELECT id, term, sum(w)::BIGINT AS wtf FROM tok GROUP BY id, term),
len AS (SELECT a.id, count(t.term) AS n FROM raw_articles a LEFT JOIN tok t USING (id) GROUP BY a.id)
"""
WORDS = """
WITH tok AS (SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '')
"""


@R.add(WORDS.rstrip().rstrip(")") + ")" + """,
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
stats AS (SELECT count(*)::DOUBLE AS n_docs, avg(n) AS avg_len FROM len),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM tok WHERE term IN ('energy', 'regulator', 'exchange', 'merger') GROUP BY doc_id, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + greatest((n_docs - df + 0.5) / (df + 0.5), 1e-6)) * f * 2.5 / greatest(f + 1.5 * (0.25 + 0.75 * n / avg_len), 1e-6)), 6) AS score
FROM tf JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    scores = bm25_scores(table(spark, folder, "documents"), "doc_id", "text", ["energy", "regulator", "exchange", "merger"])
    return scores.orderBy(F.desc("score"), "doc_id").limit(20)


@R.add(TOKENS + "SELECT id, term, wtf FROM post")
def term_postings(spark: SparkSession, folder: str) -> DataFrame:
    return index.postings(table(spark, folder, "raw_articles"), "id", "title", "lede")


@R.add(TOKENS + "SELECT term, count(*) AS df, sum(wtf)::BIGINT AS total_wtf FROM post GROUP BY term")
def term_postings_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_stats(term_postings(spark, folder))


@R.add()
def term_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and postings of each of 32 shards by crc32; DuckDB has no crc32."""
    from larkspur.functions.sketch import shard

    post = term_postings(spark, folder)
    return post.groupBy(shard(F.col("term")).alias("shard")).agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


@R.add(TOKENS + ", s AS (SELECT count(*) AS n_docs, greatest(1.0, avg(greatest(1, n))) AS avg_length FROM len) SELECT id, n AS length, round(0.25 + 0.75 * n / avg_length, 6) AS length_norm, n_docs FROM len, s")
def doc_length_norms(spark: SparkSession, folder: str) -> DataFrame:
    lens = index.lengths(table(spark, folder, "raw_articles"), "id", "title", "lede")
    stats = index.corpus_stats(lens)
    return lens.crossJoin(F.broadcast(stats)).select("id", F.col("length").cast("bigint").alias("length"), F.round(0.25 + 0.75 * F.col("length") / F.col("avg_length"), 6).alias("length_norm"), "n_docs")


@R.add("""
SELECT 'source' AS facet, source AS value, count(*) AS n FROM raw_articles GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM raw_articles GROUP BY lang""")
def doc_facets(spark: SparkSession, folder: str) -> DataFrame:
    return index.facets(table(spark, folder, "raw_articles"), ["source", "lang"])


@R.add("SELECT source, batch_no, count(*) AS n, grouping(source)::INT AS no_source, grouping(batch_no)::INT AS no_batch FROM raw_articles GROUP BY GROUPING SETS ((source), (batch_no), (source, batch_no), ())")
def facet_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "raw_articles")
    return articles.groupingSets([["source"], ["batch_no"], ["source", "batch_no"], []], "source", "batch_no").agg(F.count("*").alias("n"), F.grouping("source").cast("int").alias("no_source"), F.grouping("batch_no").cast("int").alias("no_batch"))


@R.add(f"""
SELECT count(*) FILTER (age <= 1440) AS last_24h, count(*) FILTER (age <= 10080) AS last_7d, count(*) FILTER (age <= 43200) AS last_30d, count(*) AS n
FROM (SELECT greatest(0, date_diff('second', received_at, TIMESTAMP '{AS_OF}')) // 60 AS age FROM raw_articles)""")
def facet_date_windows(spark: SparkSession, folder: str) -> DataFrame:
    aged = table(spark, folder, "raw_articles").select(minutes_since(F.col("received_at")).alias("age"))
    return aged.agg(F.count_if(F.col("age") <= 1440).alias("last_24h"), F.count_if(F.col("age") <= 10080).alias("last_7d"), F.count_if(F.col("age") <= 43200).alias("last_30d"), F.count("*").alias("n"))


def minutes_since(moment):  # noqa: ANN001, ANN201
    """Whole minutes from a moment to AS_OF, 0 for later ones."""
    return F.floor(F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.date_trunc("second", moment.cast("timestamp")), F.lit(AS_OF).cast("timestamp"))) / 60)


QUERY_TERMS = ["pension", "regulator", "merger", "outlook"]
BM25 = """, df AS (SELECT term, count(*)::DOUBLE AS df FROM post WHERE term IN ('pension', 'regulator', 'merger', 'outlook') GROUP BY term),
s AS (SELECT count(*)::DOUBLE AS n_docs, greatest(1.0, avg(greatest(1, n))) AS avg_length FROM len),
bm AS (SELECT id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * greatest(1, n) / avg_length))) AS bm25
  FROM post JOIN df USING (term) JOIN len USING (id), s GROUP BY id)
"""


@R.add(TOKENS + BM25 + "SELECT id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 20 OFFSET 20")
def bm25_weighted_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of 20 results."""
    scores = index.weighted_bm25(table(spark, folder, "raw_articles"), "id", "title", "lede", QUERY_TERMS)
    return scores.select("id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "id").offset(20).limit(20)


@R.add(TOKENS + BM25 + f"""
SELECT id, round(bm25 + 0.2 * exp(-(greatest(0, date_diff('second', received_at, TIMESTAMP '{AS_OF}')) // 60) / 4320.0) + 0.15 * coalesce(trust, 0.6)
  + 0.05 * least(2, coalesce(len(list_filter(list_distinct(list_transform(entities, lambda e: lower(trim(e)))), lambda e: contains(e, 'holdings') OR contains(e, 'labs'))), 0))
  + CASE WHEN contains(lower(coalesce(title, '') || ' ' || coalesce(lede, '')), 'pension board') THEN 0.1 ELSE 0 END, 6) AS score
FROM bm JOIN raw_articles USING (id)
LEFT JOIN (SELECT lower(name) AS src, max(trust_score) AS trust FROM news_sources GROUP BY 1) t ON t.src = lower(trim(source))
ORDER BY score DESC, id LIMIT 50""")
def bm25_boosted(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 with boosts for recency, trust in the source, entities and a phrase."""
    articles = table(spark, folder, "raw_articles")
    scores = index.weighted_bm25(articles, "id", "title", "lede", QUERY_TERMS)
    trust = table(spark, folder, "news_sources").groupBy(F.lower("name").alias("_src")).agg(F.max("trust_score").alias("_trust"))
    names = F.array_distinct(F.transform("entities", lambda e: F.lower(F.trim(e))))
    hits = F.coalesce(F.size(F.filter(names, lambda e: e.contains("holdings") | e.contains("labs"))), F.lit(0))
    phrase = F.lower(F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("lede")))).contains("pension board")
    # The table of sources is fixed by the data model.
    joined = scores.join(articles, "id").join(F.broadcast(trust), F.lower(F.trim("source")) == F.col("_src"), "left")
    score = F.col("bm25") + 0.2 * F.exp(-minutes_since(F.col("received_at")) / 4320.0) + 0.15 * F.coalesce("_trust", F.lit(0.6)) + 0.05 * F.least(F.lit(2), F.when(F.col("entities").isNull(), 0).otherwise(hits)) + F.when(phrase, 0.1).otherwise(0.0)
    return joined.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@R.add(f"SELECT id, source FROM raw_articles WHERE greatest(0, date_diff('second', received_at, TIMESTAMP '{AS_OF}')) // 60 <= 43200 AND lower(lang) = 'en' AND source IN ('Drapaex Ledger', 'Zaldrabura Courier')")
def filter_recency_lang_source(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "raw_articles")
    return articles.where((minutes_since(F.col("received_at")) <= 43200) & (F.lower("lang") == "en") & F.col("source").isin("Drapaex Ledger", "Zaldrabura Courier")).select("id", "source")


@R.add("SELECT doc_id FROM documents WHERE contains(lower(text), 'the pension board') OR contains(lower(text), 'a second round may follow')")
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    plain = F.lower("text")
    return table(spark, folder, "documents").where(plain.contains("the pension board") | plain.contains("a second round may follow")).select("doc_id")


@R.add("""
SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '"([^"\\n]+)"', 1), lambda p: trim(p)), lambda p: p <> '') AS phrases
FROM documents WHERE contains(text, '"')""")
def quoted_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("text").contains('"')).select("doc_id", tx.quoted_phrases(F.col("text")).alias("phrases"))


@R.add(f"""
WITH tok AS (SELECT id, term, count(*) AS c FROM (SELECT id, {sql_terms("coalesce(title, '') || ' ' || coalesce(lede, '')")} AS term FROM raw_articles) WHERE length(term) > 1 AND term NOT IN ({STOP}) GROUP BY id, term),
bits AS (SELECT id, b, sum(CASE WHEN (instr('0123456789abcdef', substr(sha256(term), b // 4 + 1, 1)) - 1) >> (3 - b % 4) & 1 = 1 THEN c ELSE -c END) AS v FROM tok, range(64) r(b) GROUP BY id, b),
nib AS (SELECT id, b // 4 AS p, sum(CASE WHEN v >= 0 THEN 8 >> (b % 4)::INT ELSE 0 END)::INT AS x FROM bits GROUP BY id, b // 4)
SELECT a.id, coalesce(h, repeat('0', 16)) AS simhash FROM raw_articles a LEFT JOIN (SELECT id, string_agg(substr('0123456789abcdef', x + 1, 1), '' ORDER BY p) AS h FROM nib GROUP BY id) USING (id)""")
def simhash_docs(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "raw_articles")
    return simhash64(articles, "id", tx.index_terms(F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("lede")))))


VALID = "WITH v AS (SELECT id, lower(trim(simhash)) AS s, received_at::DATE AS day, lang FROM raw_articles WHERE regexp_full_match(lower(trim(simhash)), '[0-9a-f]{16}') AND lower(trim(simhash)) <> repeat(substr(trim(lower(simhash)), 1, 1), 16))"
BITS = "bit_count(xor(('0x' || a.s)::UBIGINT::HUGEINT, ('0x' || b.s)::UBIGINT::HUGEINT))::INT"


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_articles").select("id", valid_hex16(F.col("simhash")).alias("s"), F.to_date("received_at").alias("day"))


@R.add(VALID + f", c AS (SELECT day, s, min(id) AS id FROM v GROUP BY day, s) SELECT a.id AS a, b.id AS b, {BITS} AS distance FROM c a JOIN c b ON a.day = b.day AND a.id < b.id AND {BITS} <= 4")
def simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of one day that differ in at most four bits, each named by its first article."""
    return dedupe.close_pairs(dedupe.classes(_hashed(spark, folder), "id", "s", "day"))


@R.add(VALID + " SELECT day::VARCHAR AS day, s AS simhash, min(id) AS first, count(*) AS size FROM v GROUP BY day, s")
def simhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of each fingerprint and day: first and number."""
    return dedupe.classes(_hashed(spark, folder), "id", "s", "day").select(F.col("block").cast("string").alias("day"), "simhash", "first", "size")


@R.add(VALID + f" SELECT DISTINCT b.id FROM v a JOIN v b ON a.day = b.day AND a.id < b.id AND {BITS} <= 4")
def simhash_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a close row of the day before them, whatever became of that one."""
    return dedupe.suppressed(_hashed(spark, folder), "id", "s", "day")


@R.add()
def simhash_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """First rows of fingerprints that greedy, first-wins suppression drops; order-dependent, so tested against brute force."""
    return dedupe.first_wins(dedupe.close_pairs(dedupe.classes(_hashed(spark, folder), "id", "s", "day"))).select(F.col("dropped").alias("id"))


@R.add("SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') = '' THEN '' ELSE sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))) END AS digest FROM documents")
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", content_digest(F.col("text")).alias("digest"))


@R.add("""
WITH d AS (SELECT min(doc_id) AS first_id, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY text)
SELECT first_id, n FROM d WHERE n > 1""")
def exact_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.trim(tx.text_of(F.col("text"))) != "")
    # Texts are grouped by a 256-bit digest, so that they are not shuffled themselves.
    return docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@R.add()
def result_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The best sentence of the first 50 results with marked terms; tested on small texts."""
    docs = table(spark, folder, "documents")
    terms = ["energy", "merger"]
    best = bm25_scores(docs, "doc_id", "text", terms).orderBy(F.desc("score"), "doc_id").limit(50)
    return best.join(docs, "doc_id").select("doc_id", "score", tx.highlighted(tx.snippet(F.col("text"), terms), terms).alias("snippet"))


@R.add("SELECT id, hits FROM (SELECT id, (contains(lower(coalesce(title, '')), 'merger')::INT + contains(lower(coalesce(lede, '')), 'merger')::INT) AS hits FROM raw_articles) WHERE hits > 0")
def field_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = sum((F.lower(tx.text_of(F.col(c))).contains("merger").cast("int") for c in ("title", "lede")), F.lit(0))
    return table(spark, folder, "raw_articles").select("id", hits.alias("hits")).where("hits > 0")

"""Queries of research reports, crawl state and small formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.operators import crawl, graph, news, reports
from larkspur.plans.graph_queries import DOM, ROLES, TRIPLES, _triples
from larkspur.plans.market_queries import returns_volatility
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table

R = Registry()
AS_OF = "2025-04-09 00:00:00"
TRIM = r"regexp_replace(coalesce({0}, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@R.add(rf"""WITH t AS (SELECT doc_id, {TRIM.format('text')} AS x FROM documents), c AS (SELECT *, substr(x, 1, 240) AS a, substr(x, 1, 200) AS b FROM t),
w AS (SELECT *, regexp_replace(b, '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*$', '') AS whole FROM c)
SELECT doc_id, CASE WHEN length(x) > 240 THEN regexp_replace(string_split(regexp_replace(a, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))[1], '[ \t\n\x0B\f\r]+$', '') || '…' ELSE x END AS summary,
CASE WHEN length(x) > 200 THEN regexp_replace(CASE WHEN whole = '' THEN b ELSE whole END, '[ \t\n\x0B\r.,;:]+$', '') || '…' ELSE x END AS truncated FROM w""")
def document_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Two short forms of every text: its first sentence, and its first whole words; being short is the feature."""
    return table(spark, folder, "documents").select("doc_id", reports.first_sentence(F.col("text")).alias("summary"), reports.truncated(F.col("text")).alias("truncated"))


@R.add(r"""SELECT news_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[ \t\n\x0B\f\r]+'), lambda w: length(w) >= 2))) AS words FROM (SELECT DISTINCT news_id, title FROM market_news)""")
def asked_words(spark: SparkSession, folder: str) -> DataFrame:
    """Titles taken as queries, as words for marking."""
    return table(spark, folder, "market_news").select("news_id", "title").distinct().select("news_id", F.array_sort(reports.asked_words(F.col("title"))).alias("words"))


@R.add(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(title, ''), '[\p{L}]+')) AS word FROM market_news)
SELECT word, CASE WHEN upper(word) = word THEN 'MERGER' WHEN regexp_matches(word, '^\p{Lu}') THEN 'Merger' ELSE 'merger' END AS suggestion FROM w""")
def suggestion_case(spark: SparkSession, folder: str) -> DataFrame:
    """One suggestion in the case of every word of the titles."""
    words = table(spark, folder, "market_news").select(F.explode(F.regexp_extract_all(tx.text_of(F.col("title")), F.lit(r"[\p{L}]+"), 0)).alias("word")).distinct()
    return words.select("word", reports.case_like(F.lit("merger"), F.col("word")).alias("suggestion"))


@R.add(r"""WITH p AS (SELECT doc_id, text, source, n_chars, len(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) AS p FROM documents)
SELECT doc_id, least(90.0, greatest(35.0, 55.0 + CASE WHEN text IS NULL THEN 0 ELSE 8 END + CASE WHEN n_chars >= 3200 THEN 10 WHEN n_chars >= 1800 THEN 6 WHEN n_chars >= 900 THEN 3 ELSE 0 END + CASE WHEN p >= 12 THEN 6 WHEN p >= 6 THEN 3 ELSE 0 END
+ CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN 4 ELSE 0 END + CASE WHEN trim(coalesce(source, ''), ' ') <> '' THEN 4 ELSE 0 END))::DOUBLE AS quality FROM p""")
def graph_source_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of documents as sources of a graph."""
    paragraphs = F.size(F.filter(F.split(tx.text_of(F.col("text")), "\n\n"), lambda x: F.trim(x) != ""))
    score = reports.source_quality(F.when(F.col("text").isNull(), "gone").otherwise("active"), F.col("n_chars"), paragraphs, F.col("text"), F.col("source"))
    return table(spark, folder, "documents").select("doc_id", score.alias("quality"))


@R.add(r"""WITH y AS (SELECT source, list_max(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9][0-9]')), lambda x: x::INT)) AS y FROM documents)
SELECT source, round(CASE WHEN max(y) IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - least(1.0, greatest(0, 2025 - max(y)) / 8))) END, 6)::DOUBLE AS freshness FROM y WHERE source IS NOT NULL GROUP BY source""")
def entity_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Freshness of each source by the latest year its texts name."""
    years = table(spark, folder, "documents").where("source IS NOT NULL").groupBy("source").agg(F.max(tx.latest_year(F.col("text"))).alias("y"))
    return years.select("source", F.round(reports.freshness(F.col("y"), 2025), 6).alias("freshness"))


@R.add("""WITH d AS (SELECT CASE WHEN count(*) OVER (PARTITION BY text) = 1 THEN 1.0 ELSE 0.0 END AS uniqueness, exp(-date_diff('day', published_at, TIMESTAMP '2025-04-09 00:00:00') / 365.0) AS freshness, least(1.0, n_chars / 2000.0) AS quality, CASE WHEN lang IS NULL THEN 0.0 ELSE 1.0 END AS consistency FROM documents)
SELECT round(least(1.0, greatest(0.0, sum(coalesce(uniqueness, 0)) / count(*))), 6)::DOUBLE AS uniqueness, round(least(1.0, greatest(0.0, sum(coalesce(freshness, 0)) / count(*))), 6)::DOUBLE AS freshness, round(least(1.0, greatest(0.0, sum(coalesce(quality, 0)) / count(*))), 6)::DOUBLE AS quality, round(least(1.0, greatest(0.0, sum(coalesce(consistency, 0)) / count(*))), 6)::DOUBLE AS consistency FROM d""")
def document_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The averages of the documents' signals."""
    docs = table(spark, folder, "documents")
    # Texts are counted by a digest, so that none is shuffled; null texts are one.
    counted = docs.groupBy(F.sha2("text", 256).alias("_d")).agg(F.count("*").alias("_n"))
    each = docs.withColumn("_d", F.sha2("text", 256)).join(counted.withColumnRenamed("_d", "_k"), F.col("_d").eqNullSafe(F.col("_k")))
    days = F.date_diff(F.to_date(F.lit(AS_OF)), F.to_date("published_at"))
    signals = each.select(F.when(F.col("_n") == 1, 1.0).otherwise(0.0).alias("uniqueness"), F.exp(-days / 365.0).alias("freshness"), F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("quality"), F.when(F.col("lang").isNull(), 0.0).otherwise(1.0).alias("consistency"))
    names = ["uniqueness", "freshness", "quality", "consistency"]
    return reports.signal_averages(signals, names).select(*[F.round(n, 6).alias(n) for n in names])


@R.add(r"""WITH k AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 6)) AS k, length(coalesce(text, '')) AS n, contains(coalesce(text, ''), '?') AS qa FROM documents),
s AS (SELECT doc_id, k, CASE WHEN n > 0 THEN 0.8 ELSE 0.0 END AS certainty, CASE WHEN n > 400 THEN 1.0 ELSE 0.0 END AS uniqueness, qa, len(list_intersect(k, ['merger', 'regulator', 'supply', 'pension'])) AS hits FROM k),
r AS (SELECT *, least(1.0, 0.5 * hits / 4.0 + 0.2 * CASE WHEN len(k) > 0 THEN hits / len(k) ELSE 0 END + 0.2 * certainty + 0.1 * uniqueness) AS r FROM s)
SELECT doc_id, round(CASE WHEN r > 0 THEN r ELSE least(1.0, 0.45 * certainty + 0.35 * uniqueness + CASE WHEN len(k) > 0 THEN 0.1 ELSE 0 END + CASE WHEN qa THEN 0.1 ELSE 0 END) END, 6)::DOUBLE AS relevance FROM r""")
def report_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance of documents to a query as a report ranks them."""
    asked = F.array(*[F.lit(w) for w in ("merger", "regulator", "supply", "pension")])
    known = F.array_distinct(F.filter(tx.ascii_words(F.col("text")), lambda w: F.length(w) >= 6))
    n = F.length(tx.text_of(F.col("text")))
    made = table(spark, folder, "documents").select("doc_id", known.alias("k"), F.when(n > 0, 0.8).otherwise(0.0).alias("c"), F.when(n > 400, 1.0).otherwise(0.0).alias("u"), tx.text_of(F.col("text")).contains("?").cast("int").alias("qa"))
    return made.select("doc_id", F.round(reports.relevance(asked, F.col("k"), F.col("c"), F.col("u"), F.col("qa")), 6).alias("relevance"))


SAID = """, d AS (SELECT DISTINCT entity, CASE WHEN role = 'object' THEN 'Receives “' || relation || '” from ' || counterpart || '.' ELSE 'Links to ' || counterpart || ' via “' || relation || '”.' END AS d FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS k FROM d)"""


@R.add(TRIPLES + ROLES + SAID + " SELECT entity, d AS description FROM d")
def fact_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact of every entity as a sentence."""
    # Roles are made distinct first, which also ends the stage that finds them: one stage of both would be too large to compile.
    roles = graph.roles(_triples(spark, folder)).distinct()
    return roles.select("entity", reports.described(F.col("role"), F.col("relation"), F.col("counterpart")).alias("description")).where("description IS NOT NULL").distinct()


@R.add(TRIPLES + ROLES + SAID + """, a AS (SELECT entity, ln(1 + count(*) FILTER (role = 'object')) / ln(1 + max(count(*) FILTER (role = 'object')) OVER ()) AS score FROM r GROUP BY entity),
f AS (SELECT entity, count(*) AS fact_count, list(d ORDER BY d) FILTER (k <= 6) AS facts FROM n GROUP BY entity) SELECT entity, round(score, 6) AS score, fact_count, facts FROM f JOIN a USING (entity) ORDER BY round(score, 6) DESC, entity LIMIT 12""")
def default_entity_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve entities shown without a query, with their first facts."""
    triples = _triples(spark, folder)
    scored = graph.authority(triples).select("entity", F.round("authority", 6).alias("score")).orderBy(F.desc("score"), "entity").limit(12)
    return scored.join(reports.summaries(graph.roles(triples)), "entity").select("entity", "score", "fact_count", "facts").orderBy(F.desc("score"), "entity")


@R.add(r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) > 2 AND w NOT IN ('home', 'menu', 'privacy', 'terms', 'subscribe', 'account', 'contact', 'login', 'signup', 'copyright', 'navigation', 'newsletter', 'cookie') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rank FROM c) SELECT doc_id, rank, w AS token, n AS count FROM r WHERE rank <= 10""")
def page_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The ten keywords of each page."""
    counts = table(spark, folder, "documents").select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return reports.keywords(counts, "doc_id", "w", "n")


@R.add("""WITH r AS (SELECT user_id, ts, event_id, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS r FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM r WHERE r IS NOT NULL),
v AS (SELECT u.user_id, round(coalesce(v, 0), 3) AS v FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, stddev_pop(r) * sqrt(252) * 100 AS v FROM l WHERE n <= 30 GROUP BY user_id) USING (user_id))
SELECT CASE WHEN v >= 60 THEN 'extremely elevated' WHEN v >= 40 THEN 'elevated' WHEN v >= 25 THEN 'moderate' ELSE 'calm' END AS label, count(*) AS n FROM v GROUP BY 1""")
def volatility_labels(spark: SparkSession, folder: str) -> DataFrame:
    return returns_volatility(spark, folder).groupBy(reports.volatility_label(F.col("volatility")).alias("label")).agg(F.count("*").alias("n"))


@R.add(f"SELECT d AS domain, contains(d, 'blogspot.') OR contains(d, 'wordpress') OR contains(d, 'medium.com') OR contains(d, 'substack.com') OR contains(d, 'tumblr.com') OR contains(d, 'reddit.com') OR contains(d, 'weebly.com') OR contains(d, 'notion.site') OR contains(d, 'github.io') AS low FROM (SELECT DISTINCT {DOM} AS d FROM raw_articles WHERE trim(coalesce(url, '')) <> '')")
def low_confidence_domains(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "")
    return pages.select(urls.domain(F.col("url")).alias("domain")).distinct().select("domain", urls.low_confidence(F.col("domain")).alias("low"))


@R.add("SELECT id, received_at FROM raw_articles ORDER BY received_at DESC NULLS LAST, id LIMIT 50")
def newest_history(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty newest entries, to which a crawler's history is cut; the bound is the feature."""
    return crawl.newest(table(spark, folder, "raw_articles").select("id", "received_at"), "received_at", "id")


@R.add(f"""WITH e AS (SELECT {DOM} AS key, id AS queued, date_trunc('day', received_at) AS due, trust_score AS priority FROM raw_articles r LEFT JOIN (SELECT lower(name) AS s, max(trust_score) AS trust_score FROM news_sources GROUP BY 1) t ON t.s = lower(trim(r.source)) WHERE trim(coalesce(url, '')) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY queued, due) AS n FROM e), k AS (SELECT *, row_number() OVER (ORDER BY due ASC NULLS FIRST, round(priority, 4) DESC NULLS LAST, queued, key) AS place FROM o WHERE n = 1)
SELECT key, queued, due, round(priority, 6) AS priority, place FROM k WHERE place <= 300""")
def crawl_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue of domains to crawl: one entry each, in the order they are due; its size is bounded."""
    trust = table(spark, folder, "news_sources").groupBy(F.lower("name").alias("_s")).agg(F.max("trust_score").alias("priority"))
    # The table of sources is fixed by the data model.
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").join(F.broadcast(trust), F.lower(F.trim("source")) == F.col("_s"), "left")
    entries = pages.select(urls.domain(F.col("url")).alias("domain"), F.col("id").alias("queued"), F.date_trunc("day", F.col("received_at").cast("timestamp")).cast("timestamp_ntz").alias("due"), "priority")
    return crawl.queue(entries, F.col("domain"), "due", "priority", "queued").select("key", "queued", "due", F.round("priority", 6).alias("priority"), F.col("place").cast("bigint").alias("place"))


@R.add("""SELECT doc_id, CASE WHEN text IS NULL THEN 'pruned' WHEN published_at IS NULL OR date_diff('second', date_trunc('second', published_at), TIMESTAMP '2025-04-09 00:00:00') > 604800 THEN 'fetched' ELSE 'kept' END AS action FROM documents""")
def graph_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """What a full rebuild of the graph does with each document."""
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("text").isNull(), "failed").otherwise("active").alias("status"), F.date_trunc("second", F.col("published_at").cast("timestamp")).alias("at"))
    return crawl.rebuilt(docs, "status", "at", AS_OF).select("doc_id", "action")


@R.add("""WITH d AS (SELECT md5(text) AS digest, published_at AS moment, doc_id FROM documents WHERE trim(coalesce(text, ''), ' ') <> '') SELECT digest, arg_min(doc_id, {'a': coalesce(moment, TIMESTAMP '1900-01-01'), 'd': doc_id}) AS url FROM d GROUP BY digest""")
def digest_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The document that first had each content."""
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.trim(tx.text_of(F.col("text"))) != "", F.md5("text")).alias("digest"), F.coalesce("published_at", F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")).alias("at"))
    return crawl.registered_digests(docs, "doc_id", "digest", "at")


NEWS = f"""WITH a AS (SELECT id, coalesce(title, '') || ' ' || coalesce(lede, '') AS text, source, entities, received_at, {DOM} AS domain, lede, trust FROM raw_articles r LEFT JOIN (SELECT lower(name) AS s, max(trust_score) AS trust FROM news_sources GROUP BY 1) t ON t.s = lower(trim(r.source))),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM a),
q AS (SELECT * FROM (VALUES ('supply', 1.0), ('supplies', 0.88), ('supplys', 0.8), ('merger', 1.0), ('merg', 0.75), ('mergers', 0.8)) v(t, wt)),
st AS (SELECT count(*)::DOUBLE AS nd, avg(len(ws)) AS av FROM w WHERE len(ws) > 0), tf AS (SELECT id, len(ws) AS n, t, wt, len(list_filter(ws, lambda x: x = t))::DOUBLE AS f FROM w, q),
df AS (SELECT t, count(*)::DOUBLE AS d FROM tf WHERE f > 0 GROUP BY t),
bm AS (SELECT id, round(sum(wt * ln(1 + greatest((nd - d + 0.5) / (d + 0.5), 1e-6)) * f * 2.5 / greatest(f + 1.5 * (0.25 + 0.75 * n / av), 1e-6)), 6) AS b FROM tf JOIN df USING (t), st WHERE f > 0 GROUP BY id),
e AS (SELECT id, sum(CASE WHEN list_has_any(x, ['supply', 'supplies', 'supplys', 'merger', 'merg', 'mergers']) THEN 2.8 WHEN len(list_filter(x, lambda y: levenshtein(y, 'supply') IN (1, 2) OR levenshtein(y, 'merger') IN (1, 2))) > 0 THEN 1.5 ELSE 0 END) AS e
  FROM (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(x, '')), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '') AS x FROM (SELECT id, unnest(entities) AS x FROM a)) GROUP BY id),
m AS (SELECT w.*, 14 * coalesce(b, 0) + CASE WHEN contains(lower(text), 'supply deal') THEN 6.0 ELSE 0 END + CASE WHEN contains(' ' || array_to_string(ws, ' ') || ' ', ' supply merger ') THEN 4.4 * 0.72 ELSE 0 END + coalesce(e, 0)
  + CASE WHEN list_has_any(list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> ''), ['supply', 'supplies', 'supplys', 'merger', 'merg', 'mergers']) THEN 3.4 ELSE 0 END
  + CASE WHEN len(list_filter(ws, lambda x: NOT list_contains(['supply', 'supplies', 'supplys', 'merger', 'merg', 'mergers'], x) AND levenshtein(x, 'supply') IN (1, 2))) > 0 THEN 1.2 ELSE 0 END
  + CASE WHEN len(list_filter(ws, lambda x: NOT list_contains(['supply', 'supplies', 'supplys', 'merger', 'merg', 'mergers'], x) AND levenshtein(x, 'merger') IN (1, 2))) > 0 THEN 1.2 ELSE 0 END AS m, greatest(0, date_diff('second', date_trunc('second', received_at), TIMESTAMP '2025-04-09 00:00:00')) / 3600.0 AS h FROM w LEFT JOIN bm USING (id) LEFT JOIN e USING (id) WHERE len(ws) > 0)
SELECT id, round(m, 6)::DOUBLE AS match, round(coalesce(trust * 100, 50) + m + CASE WHEN received_at IS NULL THEN 0 WHEN h <= 4 THEN 12 WHEN h <= 12 THEN 8 WHEN h <= 24 THEN 5 WHEN h <= 72 THEN 3 WHEN h <= 168 THEN 1.5 ELSE 0 END + CASE WHEN trim(coalesce(lede, ''), ' ') <> '' THEN 12 ELSE 4 END, 6)::DOUBLE AS weight
FROM m WHERE m > 0 ORDER BY weight DESC, id LIMIT 40"""


@R.add(NEWS)
def news_search(spark: SparkSession, folder: str) -> DataFrame:
    """The forty best articles for a query with a phrase, by BM25, all signals of a match, quality, recency and kind."""
    trust = table(spark, folder, "news_sources").groupBy(F.lower("name").alias("_s")).agg(F.max("trust_score").alias("_t"))
    # The table of sources is fixed by the data model.
    articles = table(spark, folder, "raw_articles").join(F.broadcast(trust), F.lower(F.trim("source")) == F.col("_s"), "left")
    docs = articles.select(
        "id", F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("lede"))).alias("text"), F.array(tx.text_of(F.col("source"))).alias("topics"), "entities", F.coalesce(F.col("_t") * 100, F.lit(50.0)).alias("quality"),
        F.col("received_at").alias("fetched_at"), F.when(F.trim(tx.text_of(F.col("lede"))) != "", "article").otherwise("page").alias("content_type"), F.lit(True).alias("ingest"), urls.domain(F.col("url")).alias("domain"),
    )
    asked = news.profile("supply merger")
    asked.phrases["supply deal"] = 1.0
    return news.search(docs, "id", asked, AS_OF, 40)

"""Queries of fingerprints, filters, collapsed results, coverage, structure and personas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.functions.sketch import valid_hex16
from larkspur.operators import dedupe, graph, index
from larkspur.plans.graph_queries import DOM
from larkspur.plans.registry import Registry
from larkspur.plans.search_queries import AS_OF, BM25, QUERY_TERMS, TOKENS, minutes_since
from larkspur.sources.tables import table

R = Registry()
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@R.add("SELECT news_id, sha256(coalesce(title, '') || '|' || coalesce(summary, '') || '|' || coalesce(source, '')) AS fingerprint FROM market_news GROUP BY ALL")
def page_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    parts = [tx.text_of(F.col(c)) for c in ("title", "summary", "source")]
    return table(spark, folder, "market_news").select("news_id", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint")).distinct()


@R.add(f"""WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c)
SELECT doc_id, substr(sha256(string_agg(w, '|' ORDER BY k)), 1, 48) AS fingerprint FROM r WHERE k <= 12 GROUP BY doc_id""")
def semantic_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each document's twelve most frequent longer words."""
    words = table(spark, folder, "documents").select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("w")).where(F.length("w") >= 4).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    best = graph.top_each(words, ["doc_id"], [F.desc("n"), F.col("w")], 12)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), "|")
    return best.groupBy("doc_id").agg(F.substring(F.sha2(joined, 256), 1, 48).alias("fingerprint"))


@R.add("""WITH l AS (SELECT doc_id, regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT s AS signature, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE s <> '' AND length(s) <= 48 GROUP BY s HAVING count(*) >= 5""")
def line_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Short lines that come at least five times, by their letters and digits."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    signed = lines.select("doc_id", F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]+", "").alias("signature")).where((F.col("signature") != "") & (F.length("signature") <= 48))
    return signed.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 5")


AGE = f"greatest(0, date_diff('second', coalesce(published_at, TIMESTAMP '1970-01-01'), TIMESTAMP '{AS_OF}'))"


@R.add(f"""SELECT CASE WHEN published_at IS NULL THEN 'unknown' WHEN {AGE} <= 3600 THEN 'past_hour' WHEN {AGE} <= 86400 THEN 'past_day' WHEN {AGE} <= 604800 THEN 'past_week' ELSE 'older' END AS bucket, doc_type, count(*) AS n FROM documents GROUP BY 1, 2""")
def recency_by_type(spark: SparkSession, folder: str) -> DataFrame:
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.date_trunc("second", F.col("published_at").cast("timestamp")), F.lit(AS_OF).cast("timestamp")))
    bucket = F.when(F.col("published_at").isNull(), "unknown").when(age <= 3600, "past_hour").when(age <= 86400, "past_day").when(age <= 604800, "past_week").otherwise("older")
    return table(spark, folder, "documents").groupBy(bucket.alias("bucket"), "doc_type").agg(F.count("*").alias("n"))


@R.add("SELECT symbol, name, CASE WHEN lower(symbol) = 'capital' OR lower(name) = 'capital' THEN 0 WHEN contains(lower(name), 'capital') THEN 1 ELSE 2 END AS how FROM companies WHERE contains(lower(symbol), 'capital') OR contains(lower(name), 'capital') OR contains(lower(coalesce(sector, '')), 'capital') ORDER BY how, symbol LIMIT 5")
def company_search(spark: SparkSession, folder: str) -> DataFrame:
    symbol, name, sector = F.lower("symbol"), F.lower("name"), F.lower(tx.text_of(F.col("sector")))
    how = F.when((symbol == "capital") | (name == "capital"), 0).when(name.contains("capital"), 1).otherwise(2)
    found = table(spark, folder, "companies").where(symbol.contains("capital") | name.contains("capital") | sector.contains("capital"))
    return found.select("symbol", "name", how.alias("how")).orderBy("how", "symbol").limit(5)


VALID = "v AS (SELECT id, lower(trim(simhash)) AS s, received_at::DATE AS day FROM raw_articles WHERE regexp_full_match(lower(trim(simhash)), '[0-9a-f]{16}') AND lower(trim(simhash)) <> repeat(substr(trim(lower(simhash)), 1, 1), 16))"


@R.add((TOKENS + BM25 + f""", {VALID}, o AS (SELECT id, round(bm25, 6) AS score, ('0x' || s)::UBIGINT::HUGEINT AS s, row_number() OVER (ORDER BY round(bm25, 6) DESC, id) AS r FROM bm LEFT JOIN v USING (id)),
k AS (SELECT 0::BIGINT AS i, []::STRUCT(id BIGINT, s HUGEINT, n BIGINT)[] AS kept UNION ALL
  SELECT i + 1, CASE WHEN s IS NULL OR len(list_filter(kept, lambda x: x.s IS NOT NULL AND bit_count(xor(x.s, s)) <= 4)) = 0 THEN list_append(kept, {{'id': id, 's': s, 'n': 0::BIGINT}})
    ELSE list_transform(kept, lambda x: CASE WHEN x.id = list_filter(kept, lambda y: y.s IS NOT NULL AND bit_count(xor(y.s, s)) <= 4)[1].id THEN {{'id': x.id, 's': x.s, 'n': x.n + 1}} ELSE x END) END FROM k JOIN o ON r = i + 1),
z AS (SELECT unnest(kept) AS x FROM k WHERE i = (SELECT count(*) FROM o))
SELECT o.id, score, x.n AS collapsed FROM z JOIN o ON o.id = x.id ORDER BY score DESC, o.id LIMIT 50""").replace("WITH tok", "WITH RECURSIVE tok", 1))
def collapsed_results(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked results without those that a better one, which stays, is close to, and the number of those."""
    articles = table(spark, folder, "raw_articles")
    scores = index.weighted_bm25(articles, "id", "title", "lede", QUERY_TERMS)
    found = articles.join(scores, "id").select("id", F.round("bm25", 6).alias("score"), valid_hex16(F.col("simhash")).alias("s"))
    kept = dedupe.collapsed(found, "id", "score", "s")
    return found.join(kept, "id").select("id", "score", "collapsed").orderBy(F.desc("score"), "id").limit(50)


def coverage(text: Column, tokens: list[str]) -> Column:
    """The share of the tokens that the text holds."""
    return F.size(F.array_intersect(tx.ascii_words(text), F.array(*[F.lit(t) for t in tokens]))) / float(len(tokens))


COVER = "len(list_intersect(list_distinct(" + WORDS + "), ['supply', 'deal', 'port'])) / 3.0"


@R.add(f"""WITH c AS (SELECT id, {COVER.format('title')} AS t, {COVER.format('lede')} AS l, {COVER.format('url')} AS u FROM raw_articles)
SELECT id, round(0.5 * t + 0.45 * l + 0.05 * u + CASE WHEN t > 0 THEN 0.2 WHEN l > 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS relevance FROM c WHERE t + l + u > 0""")
def source_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of a query by title, text and address."""
    t, l, u = (coverage(F.col(c), ["supply", "deal", "port"]) for c in ("title", "lede", "url"))
    return table(spark, folder, "raw_articles").where(t + l + u > 0).select("id", F.round(0.5 * t + 0.45 * l + 0.05 * u + F.when(t > 0, 0.2).when(l > 0, 0.1).otherwise(0.0), 6).alias("relevance"))


@R.add("""WITH p AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10) || chr(10)), lambda x: trim(x, chr(10) || ' ') <> '') AS p, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: list_contains(['however', 'though', 'because', 'while', 'after', 'despite', 'which'], x))) AS t FROM documents)
SELECT doc_id, len(p) AS paragraphs, t AS transitions, round(least(1.0, len(p) / 6.0) * 0.6 + least(1.0, t / 5.0) * 0.4, 6)::DOUBLE AS structure FROM p""")
def structure_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and words of transition."""
    words = ["however", "though", "because", "while", "after", "despite", "which"]
    text = F.replace(tx.text_of(F.col("text")), F.lit("\r"), F.lit(""))
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, "^[\n ]+|[\n ]+$", "") != ""))
    moves = F.size(F.filter(tx.ascii_words(F.col("text")), lambda w: w.isin(words)))
    return table(spark, folder, "documents").select("doc_id", paragraphs.cast("bigint").alias("paragraphs"), moves.cast("bigint").alias("transitions"), F.round(F.least(F.lit(1.0), paragraphs / 6.0) * 0.6 + F.least(F.lit(1.0), moves / 5.0) * 0.4, 6).alias("structure"))


@R.add(f"""WITH s AS (SELECT doc_id, unnest(range(1, len(x))) AS i, x FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda y: list_distinct(list_filter(regexp_split_to_array(lower(y), '[^a-z0-9]+'), lambda w: length(w) >= 4))), lambda y: len(y) > 0) AS x FROM documents) WHERE len(x) > 1),
o AS (SELECT doc_id, len(list_intersect(x[i], x[i + 1])) / least(len(x[i]), len(x[i + 1]))::DOUBLE AS o FROM s)
SELECT doc_id, count(*) AS joints, round(avg(o), 6) AS cohesion FROM o GROUP BY doc_id""")
def cohesion_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Longer words that neighbouring sentences share."""
    sets = F.filter(F.transform(F.split(tx.text_of(F.col("text")), "[.!?]+"), lambda y: F.array_distinct(F.filter(tx.ascii_words(y), lambda w: F.length(w) >= 4))), lambda y: F.size(y) > 0)
    each = table(spark, folder, "documents").select("doc_id", sets.alias("x")).where(F.size("x") > 1)
    joints = each.select("doc_id", F.explode(F.arrays_zip(F.slice("x", 1, F.size("x") - 1).alias("a"), F.slice("x", 2, F.size("x") - 1).alias("b"))).alias("p"))
    share = F.size(F.array_intersect("p.a", "p.b")) / F.least(F.size("p.a"), F.size("p.b"))
    return joints.groupBy("doc_id").agg(F.count("*").alias("joints"), F.round(F.avg(share), 6).alias("cohesion"))


PERSONAS = [("institutional", ["pension", "fund", "bonds"]), ("trader", ["shares", "exchange", "moved"]), ("executive", ["merger", "stake", "dividend"])]
PERSONA_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{k}')" for k in ks) + f" THEN '{p}' END" for p, ks in PERSONAS)


@R.add(f"""WITH a AS (SELECT DISTINCT article_id, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS t, sentiment_score AS s, strftime(received_at, '%Y-%m') AS month FROM sentiment_articles WHERE sentiment_score IS NOT NULL),
p AS (SELECT article_id, s, month, list_filter([{PERSONA_SQL}], lambda x: x IS NOT NULL) AS l FROM a), q AS (SELECT s, month, unnest(CASE WHEN len(l) = 0 THEN ['retail'] ELSE l END) AS persona FROM p)
SELECT month, persona, count(*) AS n, round(avg(s), 6) AS score FROM q GROUP BY 1, 2""")
def persona_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment by month and the readers that an article speaks to, retail by default."""
    from larkspur.operators.analysis import all_matches

    once = table(spark, folder, "sentiment_articles").where("sentiment_score IS NOT NULL").select("article_id", F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("summary"))).alias("t"), F.col("sentiment_score").alias("s"), F.date_format("received_at", "yyyy-MM").alias("month")).select("article_id", F.lower("t").alias("t"), "s", "month").distinct()
    hits = all_matches(F.col("t"), PERSONAS)
    spoken = once.select("s", "month", F.explode(F.when(F.size(hits) == 0, F.array(F.lit("retail"))).otherwise(hits)).alias("persona"))
    return spoken.groupBy("month", "persona").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("score"))


@R.add(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 12) AS s FROM documents)
SELECT doc_id, k AS keyword, list_filter(s, lambda x: contains(lower(x), k))[1] AS highlight FROM s, (VALUES ('regulator'), ('exchange')) v(k) WHERE len(list_filter(s, lambda x: contains(lower(x), k))) > 0""")
def topic_highlights(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of each document for each topic."""
    said = F.filter(F.transform(F.split(tx.text_of(F.col("text")), "[.!?]+"), lambda s: tx.squeezed(s)), lambda s: F.length(s) >= 12)
    each = table(spark, folder, "documents").select("doc_id", said.alias("s"), F.explode(F.array(F.lit("regulator"), F.lit("exchange"))).alias("keyword"))
    hits = F.filter("s", lambda x: F.lower(x).contains(F.col("keyword")))
    return each.where(F.size(hits) > 0).select("doc_id", "keyword", F.element_at(hits, 1).alias("highlight"))


@R.add("SELECT doc_id, length(regexp_replace(trim(coalesce(text, '') || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(doc_type, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS length FROM documents")
def composite_text_length(spark: SparkSession, folder: str) -> DataFrame:
    """The length of a document's fields put together."""
    parts = [tx.text_of(F.col(c)) for c in ("text", "source", "lang", "doc_type")]
    return table(spark, folder, "documents").select("doc_id", F.length(F.regexp_replace(F.trim(F.concat_ws(" ", *parts)), tx.SPACE, " ")).cast("bigint").alias("length"))


@R.add("""SELECT c.symbol, coalesce(avg_score, 0.0) AS score, coalesce(n, 0) AS articles, avg_score IS NULL AS fallback FROM companies c LEFT JOIN (SELECT upper(trim(symbol)) AS symbol, round(avg(sentiment_score), 6) AS avg_score, count(*) AS n FROM (SELECT DISTINCT article_id, symbol, sentiment_score FROM sentiment_articles) WHERE sentiment_score IS NOT NULL GROUP BY 1) s ON s.symbol = c.symbol""")
def sentiment_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Each company's sentiment, neutral where there is none."""
    scored = table(spark, folder, "sentiment_articles").select("article_id", F.upper(F.trim("symbol")).alias("symbol"), "sentiment_score").distinct().where("sentiment_score IS NOT NULL").groupBy("symbol").agg(F.round(F.avg("sentiment_score"), 6).alias("a"), F.count("*").alias("n"))
    return table(spark, folder, "companies").join(scored, "symbol", "left").select("symbol", F.coalesce("a", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("articles"), F.col("a").isNull().alias("fallback"))


@R.add(f"""SELECT {DOM} AS domain, min(received_at) AS first_seen, max(received_at) AS last_seen, round(greatest(0, date_diff('second', max(received_at), TIMESTAMP '{AS_OF}')) // 60 / 60.0, 4)::DOUBLE AS idle_hours, round(avg(exp(-(greatest(0, date_diff('second', received_at, TIMESTAMP '{AS_OF}')) // 60) / 60.0 / 48)), 6) AS freshness FROM raw_articles WHERE trim(coalesce(url, '')) <> '' GROUP BY 1""")
def domain_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """First and last sight of each domain, and its mean freshness e^(-hours / 48)."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(urls.domain(F.col("url")).alias("domain"), "received_at", minutes_since(F.col("received_at")).alias("m"))
    return pages.groupBy("domain").agg(F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.round(F.min("m") / 60.0, 4).alias("idle_hours"), F.round(F.avg(F.exp(-F.col("m") / 60.0 / 48)), 6).alias("freshness"))


@R.add("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS running, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week_mean, first_value(n) OVER (PARTITION BY event_type ORDER BY day) AS first_n FROM d""")
def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts with their running sum, seven-day mean and first value."""
    daily = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type").orderBy("day")
    return daily.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.sum("n").over(by).alias("running"), F.round(F.avg("n").over(by.rowsBetween(-6, 0)), 6).alias("week_mean"), F.first("n").over(by).alias("first_n"))


@R.add("""WITH k AS (SELECT lower(trim(name)) AS n FROM news_sources UNION SELECT lower(trim(unnest(aliases))) FROM news_sources)
SELECT id FROM raw_articles WHERE trim(coalesce(source, '')) <> '' AND EXISTS (SELECT 1 FROM k WHERE n = lower(trim(source)))""")
def known_sources_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "news_sources").select(F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select(F.lower(F.trim("n")).alias("n")).distinct()
    articles = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("source"))) != "")
    # The table of sources is fixed by the data model.
    return articles.join(F.broadcast(known), F.lower(F.trim("source")) == F.col("n"), "left_semi").select("id")

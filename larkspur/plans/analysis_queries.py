"""Queries of deeper text analysis, facets of quality, suggestions, and scheduling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.operators import analysis
from larkspur.plans.graph_queries import DOM
from larkspur.plans.registry import Registry
from larkspur.plans.search_queries import AS_OF, minutes_since
from larkspur.sources.tables import table

R = Registry()
# Topics with the words of which one is enough.
TOPICS = [
    ("Technology", ["technology", "tech", "software", "ai", "artificial intelligence", "robot", "cloud", "startup", "computing", "internet", "app", "cybersecurity", "semiconductor", "chip", "quantum"]),
    ("Finance", ["bank", "banking", "interest rate", "inflation", "loan", "credit", "debt", "mortgage", "treasury", "dollar", "currency", "exchange"]),
    ("Energy", ["energy", "oil", "gas", "renewable", "solar", "wind", "power", "battery", "nuclear"]),
    ("Healthcare", ["health", "medical", "pharma", "drug", "vaccine", "hospital", "biotech", "clinical"]),
    ("Geopolitics", ["election", "government", "policy", "war", "conflict", "diplomatic", "sanction", "president", "parliament"]),
    ("Climate", ["climate", "weather", "warming", "emission", "carbon", "wildfire", "flood", "storm"]),
    ("Consumer", ["retail", "consumer", "shopping", "e-commerce", "sales", "fashion", "brand"]),
    ("Transportation", ["transport", "airline", "flight", "rail", "automotive", "car", "vehicle", "shipping", "logistics"]),
    ("Science", ["research", "science", "space", "nasa", "study", "scientist", "laboratory", "experiment"]),
    ("Sports", ["sport", "sports", "tournament", "league", "match", "olympic"]),
    ("Culture", ["culture", "movie", "film", "music", "art", "festival", "entertainment"]),
]
# Intents with the points and the phrases that show them.
INTENTS = [
    ("informative", 0.6, ["according to", "analysis", "data shows", "evidence", "findings", "reported", "research", "study"]), ("persuasive", 0.8, ["should ", "must ", "we urge", "we recommend", "need to", "call to action", "imperative", "critical that"]),
    ("instructional", 0.8, ["how to", "step ", "first,", "next,", "finally,", "guide", "instructions", "procedure"]), ("narrative", 0.7, ["i remember", "i was", "we were", "story", "journey", "experience", "chapter", "narrative"]),
    ("expressive", 0.8, ["i feel", "i believe", "i think", "excited", "thrilled", "worried", "anxious", "frustrated", "grateful", "proud", "happy", "angry"]), ("conversational", 0.3, ["you ", "your "]),
]


def _sql_any(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in phrases) + ")"


@R.add("SELECT topic, count(*) AS docs FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {_sql_any(p)} THEN '{n}' END" for n, p in TOPICS) + "], lambda x: x IS NOT NULL)) AS topic FROM documents) GROUP BY topic")
def topic_tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.explode(analysis.all_matches(F.col("text"), TOPICS)).alias("topic")).groupBy("topic").agg(F.count("*").alias("docs"))


PARTS = [f"({'0.2 * (coalesce(text, $$$$) <> $$$$)::INT + ' if n == 'informative' else ''}{w} * {_sql_any(p)}::INT)".replace("$$$$", "''") for n, w, p in INTENTS]


@R.add("WITH s AS (SELECT doc_id, [" + ", ".join(f"{p}::DOUBLE" for p in PARTS) + "] AS v FROM documents), t AS (SELECT doc_id, v, list_sum(v) AS n FROM s) SELECT doc_id, CASE WHEN n > 0 THEN ['" + "', '".join(n for n, *_ in INTENTS) + "'][list_position(v, list_max(v))] ELSE 'informative' END AS intent, round(CASE WHEN n > 0 THEN list_max(v) / n ELSE 1.0 END, 6) AS confidence FROM t")
def intent(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest of six intents by phrases, the first of equals, with its share."""
    low = F.lower(tx.text_of(F.col("text")))
    scores = []
    for name, weight, phrases in INTENTS:
        hit = F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), weight).otherwise(0.0)
        scores.append((F.when(low != "", 0.2).otherwise(0.0) + hit) if name == "informative" else hit)
    values = F.array(*scores)
    each = table(spark, folder, "documents").select("doc_id", values.alias("v"), reduce(lambda a, b: a + b, scores).alias("n"))
    best = F.array_max("v")
    name = F.element_at(F.array(*[F.lit(n) for n, *_ in INTENTS]), F.array_position("v", best).cast("int"))
    return each.select("doc_id", F.when(F.col("n") > 0, name).otherwise("informative").alias("intent"), F.round(F.when(F.col("n") > 0, best / F.col("n")).otherwise(1.0), 6).alias("confidence"))


@R.add()
def key_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The three best phrases of each document; tested against plain Python."""
    return analysis.key_phrases(table(spark, folder, "documents"), "doc_id", "text", tx.STOPWORDS, 3)


@R.add()
def acronym_expansions(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms with what they stand for; tested on small texts."""
    return analysis.acronyms(table(spark, folder, "documents"), "doc_id", "text")


@R.add()
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs joined to sections; a scan with state, tested on small texts."""
    return analysis.sections(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "section", "paragraphs")


TITLE = "SELECT * FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+')) AS w FROM market_news) WHERE length(w) >= 5"


@R.add(f"""WITH t AS ({TITLE}), c AS (SELECT w, count(*) AS n FROM t GROUP BY w), k AS (SELECT w FROM c WHERE n >= 3), u AS (SELECT w FROM c WHERE n < 3),
p AS (SELECT u.w AS word, k.w AS suggestion, levenshtein(u.w, k.w) AS d FROM u JOIN k ON abs(length(u.w) - length(k.w)) <= 2 AND levenshtein(u.w, k.w) BETWEEN 1 AND 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(d + CASE WHEN substr(word, 1, 1) <> substr(suggestion, 1, 1) THEN 0.1 ELSE 0 END + CASE WHEN substr(word, 1, 2) <> substr(suggestion, 1, 2) THEN 0.05 ELSE 0 END + 0.01 * abs(length(word) - length(suggestion)), 6), suggestion) AS rank FROM p)
SELECT word, rank, suggestion, d::INT AS distance FROM r WHERE rank <= 3""")
def spelling_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """For rare words of titles the likeliest frequent ones."""
    counted = table(spark, folder, "market_news").select(F.explode(tx.ascii_words(F.col("title"))).alias("w")).where(F.length("w") >= 5).groupBy("w").agg(F.count("*").alias("n"))
    return analysis.spelling(counted.where("n < 3"), "w", counted.where("n >= 3"), "w", 3)


@R.add(f"""WITH t AS (SELECT * FROM (SELECT news_id, unnest(regexp_split_to_array(lower(coalesce(summary, '')), '[^a-z0-9]+')) AS w FROM (SELECT DISTINCT news_id, summary FROM market_news)) WHERE length(w) >= 4),
f AS (SELECT news_id, w, count(*)::DOUBLE AS x FROM t GROUP BY 1, 2), n AS (SELECT news_id, sqrt(sum(x * x)) AS n FROM f GROUP BY 1),
s AS (SELECT a.news_id AS query, b.news_id, sum(a.x * b.x) / (max(p.n) * max(q.n)) AS score FROM f a JOIN f b ON a.w = b.w AND a.news_id <> b.news_id AND a.news_id % 50 = 0 JOIN n p ON p.news_id = a.news_id JOIN n q ON q.news_id = b.news_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, news_id) AS rank FROM s WHERE score >= 0.2)
SELECT query, rank, news_id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The five news nearest to every one whose id is divisible by 50."""
    news = table(spark, folder, "market_news").select("news_id", "summary").distinct()
    weights = news.select("news_id", F.explode(tx.ascii_words(F.col("summary"))).alias("w")).where(F.length("w") >= 4).groupBy("news_id", "w").agg(F.count("*").cast("double").alias("x"))
    found = analysis.related_documents(weights, "news_id", "w", "x", F.col("news_id") % 50 == 0, 0.2, 5)
    return found.withColumn("score", F.round("score", 5))


QUALITY = "least(97.5, greatest(0.0, 40.0 + least(30.0, coalesce(n_chars, 0) / 100.0) + CASE WHEN lang IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN article_id IS NOT NULL THEN 10 ELSE 0 END - CASE WHEN trim(coalesce(text, '')) = '' THEN 40 ELSE 0 END))"


def _quality() -> Column:
    score = 40.0 + F.least(F.lit(30.0), F.coalesce("n_chars", F.lit(0)) / 100.0) + F.when(F.col("lang").isNotNull(), 10).otherwise(0) + F.when(F.col("article_id").isNotNull(), 10).otherwise(0) - F.when(F.trim(tx.text_of(F.col("text"))) == "", 40).otherwise(0)
    return F.least(F.lit(97.5), F.greatest(F.lit(0.0), score))


def bucket(score: Column) -> Column:
    return F.when(score >= 90, "exceptional").when(score >= 70, "high").when(score >= 50, "moderate").otherwise("low")


@R.add(f"WITH q AS (SELECT doc_type, {QUALITY} AS s FROM documents), b AS (SELECT CASE WHEN s >= 90 THEN 'exceptional' WHEN s >= 70 THEN 'high' WHEN s >= 50 THEN 'moderate' ELSE 'low' END AS bucket, s FROM q) SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 3) AS share, round(avg(s), 4) AS mean FROM b GROUP BY bucket")
def quality_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets of quality with their share of all."""
    scored = table(spark, folder, "documents").select(_quality().alias("s")).select(bucket(F.col("s")).alias("bucket"), "s")
    each = scored.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean"))
    total = each.agg(F.sum("n").alias("t"))
    return each.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") / F.col("t"), 3).alias("share"), "mean")


AGE = f"greatest(0, date_diff('second', published_at, TIMESTAMP '{AS_OF}')) // 60"


@R.add(f"""SELECT doc_id, round({QUALITY} + CASE WHEN published_at IS NULL THEN 0 WHEN {AGE} <= 240 THEN 12 WHEN {AGE} <= 720 THEN 8 WHEN {AGE} <= 1440 THEN 5 WHEN {AGE} <= 4320 THEN 3 WHEN {AGE} <= 10080 THEN 1.5 ELSE 0 END
 + CASE doc_type WHEN 'article' THEN 12 WHEN 'page' THEN 4 WHEN 'note' THEN -8 ELSE 0 END, 4) AS weight FROM documents ORDER BY weight DESC, doc_id LIMIT 24""")
def news_weight(spark: SparkSession, folder: str) -> DataFrame:
    """The 24 heaviest documents by quality, recency step and type."""
    age = minutes_since(F.col("published_at"))
    step = F.when(F.col("published_at").isNull(), 0.0)
    for minutes, points in ((240, 12.0), (720, 8.0), (1440, 5.0), (4320, 3.0), (10080, 1.5)):
        step = step.when(age <= minutes, points)
    kind = F.when(F.col("doc_type") == "article", 12.0).when(F.col("doc_type") == "page", 4.0).when(F.col("doc_type") == "note", -8.0).otherwise(0.0)
    weighed = table(spark, folder, "documents").select("doc_id", F.round(_quality() + step.otherwise(0.0) + kind, 4).alias("weight"))
    return weighed.orderBy(F.desc("weight"), "doc_id").limit(24)


@R.add("""WITH k AS (SELECT DISTINCT * FROM (SELECT lower(trim(source)) AS s, lower(trim(unnest(entities))) AS e FROM raw_articles) WHERE s <> '' AND e <> ''), n AS (SELECT s, count(*) AS n FROM k GROUP BY s),
p AS (SELECT a.s AS l, b.s AS r, count(*) AS shared FROM k a JOIN k b ON a.e = b.e AND a.s < b.s GROUP BY 1, 2), j AS (SELECT l, r, shared / (x.n + y.n - shared)::DOUBLE AS sim FROM p JOIN n x ON x.s = l JOIN n y ON y.s = r),
b AS (SELECT l AS s, sim FROM j UNION ALL SELECT r, sim FROM j) SELECT n.s AS source, n AS entities, round(1 - coalesce(max(sim), 0), 6) AS uniqueness FROM n LEFT JOIN b ON b.s = n.s GROUP BY ALL""")
def source_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """One less the highest likeness of a source's entities to another source's."""
    held = table(spark, folder, "raw_articles").select(F.lower(F.trim("source")).alias("source"), F.explode("entities").alias("e")).select("source", F.lower(F.trim("e")).alias("e")).where("source <> '' AND e <> ''").distinct()
    n = held.groupBy("source").agg(F.count("*").alias("entities"))
    a, b = held.select(F.col("source").alias("l"), "e"), held.select(F.col("source").alias("r"), "e")
    shared = a.join(b, "e").where("l < r").groupBy("l", "r").agg(F.count("*").alias("k"))
    sim = shared.join(n.select(F.col("source").alias("l"), F.col("entities").alias("x")), "l").join(n.select(F.col("source").alias("r"), F.col("entities").alias("y")), "r").withColumn("s", F.col("k") / (F.col("x") + F.col("y") - F.col("k")))
    best = sim.select(F.col("l").alias("source"), "s").unionAll(sim.select(F.col("r").alias("source"), "s")).groupBy("source").agg(F.max("s").alias("m"))
    return n.join(best, "source", "left").select("source", "entities", F.round(1 - F.coalesce("m", F.lit(0.0)), 6).alias("uniqueness"))


@R.add("""WITH k AS (SELECT source, lower(trim(unnest(entities))) AS e FROM raw_articles) SELECT e AS entity, count(*) AS n, count(DISTINCT source) AS sources FROM k WHERE e <> '' GROUP BY e ORDER BY n DESC, entity LIMIT 10""")
def topic_summary(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "raw_articles").select("source", F.explode("entities").alias("e")).select("source", F.lower(F.trim("e")).alias("entity")).where("entity <> ''")
    return held.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).orderBy(F.desc("n"), "entity").limit(10)


@R.add("""WITH e AS (SELECT lower(trim(unnest(entities))) AS v, 0.78 AS w FROM raw_articles), s AS (SELECT lower(trim(name)) AS v, 0.7 AS w FROM news_sources UNION ALL SELECT lower(trim(unnest(aliases))), 0.68 FROM news_sources UNION ALL SELECT lower(trim(name)), 0.85 FROM companies UNION ALL SELECT * FROM e)
SELECT v AS value, max(w)::DOUBLE AS score FROM s WHERE v <> '' GROUP BY v ORDER BY score DESC, value LIMIT 20""")
def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Autocompletions: the best weight of each value over several kinds."""
    def part(df: DataFrame, column: Column, weight: float) -> DataFrame:
        return df.select(F.lower(F.trim(column)).alias("value"), F.lit(weight).alias("w"))

    articles, sources, firms = (table(spark, folder, t) for t in ("raw_articles", "news_sources", "companies"))
    every = part(articles.select(F.explode("entities").alias("x")), F.col("x"), 0.78).unionAll(part(sources, F.col("name"), 0.7)).unionAll(part(sources.select(F.explode("aliases").alias("x")), F.col("x"), 0.68)).unionAll(part(firms, F.col("name"), 0.85))
    return every.where("value <> ''").groupBy("value").agg(F.max("w").alias("score")).orderBy(F.desc("score"), "value").limit(20)


@R.add("WITH d AS (SELECT strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n FROM raw_articles GROUP BY 1) SELECT * FROM (SELECT * FROM d ORDER BY day DESC LIMIT 8) ORDER BY day")
def ingestion_timeline(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "raw_articles").groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return daily.orderBy(F.desc("day")).limit(8).orderBy("day")


@R.add("SELECT count(*) AS articles, count(DISTINCT received_at::DATE) AS days, round(count(*) / count(DISTINCT received_at::DATE)::DOUBLE, 6) AS per_day, round(count(*) FILTER (len(entities) > 0) * 100.0 / count(*), 6)::DOUBLE AS with_entities, round(avg(CASE WHEN len(entities) > 0 THEN len(entities) END), 6) AS entities_each FROM raw_articles")
def coverage_signals(spark: SparkSession, folder: str) -> DataFrame:
    days = F.count_distinct(F.to_date("received_at"))
    some = F.size("entities") > 0
    return table(spark, folder, "raw_articles").agg(F.count("*").alias("articles"), days.alias("days"), F.round(F.count("*") / days, 6).alias("per_day"), F.round(F.count_if(some) * 100.0 / F.count("*"), 6).alias("with_entities"), F.round(F.avg(F.when(some, F.size("entities"))), 6).alias("entities_each"))


@R.add(f"""WITH p AS (SELECT {DOM} AS d, received_at, row_number() OVER (PARTITION BY {DOM} ORDER BY received_at, id) AS r, lag(received_at) OVER (PARTITION BY {DOM} ORDER BY received_at, id) AS before FROM raw_articles WHERE trim(coalesce(url, '')) <> ''),
m AS (SELECT d, count(before) AS samples, median(date_diff('second', date_trunc('second', before), date_trunc('second', received_at)) / 60.0) AS med, max(received_at) AS last FROM p GROUP BY d)
SELECT d AS domain, round(least(1440.0, greatest(15.0, coalesce(med, 360.0) * 1.5)), 3) AS interval_minutes, CASE WHEN date_diff('second', date_trunc('second', last), TIMESTAMP '{AS_OF}') / 60.0 >= least(1440.0, greatest(15.0, coalesce(med, 360.0) * 1.5)) THEN 'due' ELSE 'scheduled' END AS state FROM m""")
def refresh_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """When a domain is due again: one and a half times its median gap, from 15 minutes to a day."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(urls.domain(F.col("url")).alias("domain"), "id", "received_at", F.date_trunc("second", F.col("received_at").cast("timestamp")).alias("at"))
    gap = F.timestamp_diff("SECOND", F.lag("at").over(Window.partitionBy("domain").orderBy("received_at", "id")), F.col("at")) / 60
    each = pages.withColumn("gap", gap).groupBy("domain").agg(F.median("gap").alias("m"), F.max("at").alias("last"))
    wait = F.least(F.lit(1440.0), F.greatest(F.lit(15.0), F.coalesce("m", F.lit(360.0)) * 1.5))
    since = F.timestamp_diff("SECOND", F.col("last"), F.lit(AS_OF).cast("timestamp")) / 60
    return each.select("domain", F.round(wait, 3).alias("interval_minutes"), F.when(since >= wait, "due").otherwise("scheduled").alias("state"))


@R.add(f"SELECT {DOM} AS domain, count(*) FILTER (batch_no = 0) AS accepted, count(*) FILTER (batch_no BETWEEN 1 AND 4) AS early, count(*) FILTER (batch_no > 4) AS late, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS unlabelled FROM raw_articles WHERE trim(coalesce(url, '')) <> '' GROUP BY 1")
def discovery_rollup(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "")
    batch = F.col("batch_no")
    return pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count_if(batch == 0).alias("accepted"), F.count_if(batch.between(1, 4)).alias("early"), F.count_if(batch > 4).alias("late"), F.count_if(F.col("lang").isNull() | (F.trim("lang") == "")).alias("unlabelled"))


@R.add("""SELECT 'doc_type' AS dimension, doc_type AS value, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY doc_type UNION ALL SELECT 'lang', lang, count(*), round(avg(n_chars), 4) FROM documents GROUP BY lang
UNION ALL SELECT 'all', NULL, count(*), round(avg(n_chars), 4) FROM documents""")
def dataset_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and mean lengths by type, by language and overall, in one pass of grouping sets."""
    sets = table(spark, folder, "documents").groupingSets([["doc_type"], ["lang"], []], "doc_type", "lang").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return sets.select(F.when(F.col("g") == 1, "doc_type").when(F.col("g") == 2, "lang").otherwise("all").alias("dimension"), F.coalesce("doc_type", "lang").alias("value"), "n", "mean_chars")


def expression_columns() -> dict[str, Column]:
    """The text expressions on a document's text, by name."""
    text = F.col("text")
    first = F.try_element_at(tx.words(text), F.lit(1))
    return {
        "fold": tx.fold(text), "entity": tx.entity_key(text), "name": tx.name_key(text), "spans": F.array_join(tx.capitalised_spans(text), "|"),
        "preview": tx.preview(text, 40), "punctuated": tx.punctuated(text), "capitalised": tx.capitalised(text), "items": F.array_join(tx.list_items(text), "|"),
        "stem": tx.stem(first), "syllables": tx.syllables(first), "highlight": tx.highlighted(text, ["the", "of"]), "age": tx.elapsed_label(F.coalesce("n_chars", F.lit(0)) * 60),
    }


@R.add()
def text_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Every text expression on every document; each is tested on small texts."""
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in expression_columns().items()])

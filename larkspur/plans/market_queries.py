"""Queries of markets, events, orders, merges and the logistic model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.operators import merge, model, series
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table

R = Registry()


@R.add("""SELECT coalesce(sector, '(none)') AS sector, grouping(sector)::INT AS total, count(*) AS companies, count(*) FILTER (change_percent > 0) AS advancers, count(*) FILTER (change_percent < 0) AS decliners, round(avg(change_percent), 6) AS avg_change FROM companies GROUP BY ROLLUP (sector)""")
def sector_rollup(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "companies").rollup("sector").agg(F.grouping("sector").cast("int").alias("total"), F.count("*").alias("companies"), F.count_if(F.col("change_percent") > 0).alias("advancers"), F.count_if(F.col("change_percent") < 0).alias("decliners"), F.round(F.avg("change_percent"), 6).alias("avg_change"))
    return by.withColumn("sector", F.coalesce("sector", F.lit("(none)")))


CAP = "CASE upper(right(trim(market_cap), 1)) WHEN 'T' THEN 1e12 WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 ELSE 1.0 END * TRY_CAST(regexp_extract(market_cap, '([0-9.]+)', 1) AS DOUBLE)"


@R.add(f"SELECT count(*) FILTER (change_percent > 0) AS advancers, count(*) FILTER (change_percent < 0) AS decliners, count(*) FILTER (change_percent = 0) AS unchanged, round(avg(change_percent), 6) AS avg_change, round(sum({CAP}) / 1e9, 3) AS total_cap_bn FROM companies")
def market_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.upper(F.right(F.trim("market_cap"), F.lit(1)))
    scale = F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6).otherwise(1.0)
    cap = scale * F.regexp_extract("market_cap", r"([0-9.]+)", 1).try_cast("double")
    change = F.col("change_percent")
    return table(spark, folder, "companies").agg(F.count_if(change > 0).alias("advancers"), F.count_if(change < 0).alias("decliners"), F.count_if(change == 0).alias("unchanged"), F.round(F.avg(change), 6).alias("avg_change"), F.round(F.sum(cap) / 1e9, 3).alias("total_cap_bn"))


@R.add("SELECT symbol, change_percent, CASE WHEN change_percent >= 0 THEN 'up' ELSE 'down' END AS direction FROM companies WHERE change_percent IS NOT NULL ORDER BY abs(change_percent) DESC, symbol LIMIT 4")
def top_movers(spark: SparkSession, folder: str) -> DataFrame:
    moved = table(spark, folder, "companies").where("change_percent IS NOT NULL")
    return moved.orderBy(F.desc(F.abs("change_percent")), "symbol").limit(4).select("symbol", "change_percent", F.when(F.col("change_percent") >= 0, "up").otherwise("down").alias("direction"))


ONCE = "a AS (SELECT DISTINCT article_id, upper(trim(symbol)) AS symbol, sentiment_score AS score, relevance_score AS relevance, received_at, source, title FROM sentiment_articles)"


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sentiment_articles").select("article_id", F.upper(F.trim("symbol")).alias("symbol"), F.col("sentiment_score").alias("score"), F.col("relevance_score").alias("relevance"), "received_at", "source", "title").distinct()


@R.add(f"WITH {ONCE} SELECT received_at::DATE::VARCHAR AS day, coalesce(symbol, '') AS symbol, count(*) AS articles, round(avg(score), 6) AS score FROM a WHERE score IS NOT NULL GROUP BY 1, 2")
def sentiment_timeline(spark: SparkSession, folder: str) -> DataFrame:
    scored = _articles(spark, folder).where("score IS NOT NULL")
    return scored.groupBy(F.to_date("received_at").cast("string").alias("day"), F.coalesce("symbol", F.lit("")).alias("symbol")).agg(F.count("*").alias("articles"), F.round(F.avg("score"), 6).alias("score"))


def ladder(score: Column) -> Column:
    """Five labels at .35 and .15 either way."""
    return F.when(score >= 0.35, "very_bullish").when(score >= 0.15, "bullish").when(score <= -0.35, "very_bearish").when(score <= -0.15, "bearish").otherwise("neutral")


@R.add(f"""WITH {ONCE}, s AS (SELECT symbol, count(*) AS articles, avg(score) AS average, arg_max(score, (received_at, article_id)) AS latest FROM a WHERE score IS NOT NULL AND symbol <> '' GROUP BY symbol)
SELECT symbol, articles, round(average, 6) AS average, round(latest, 6) AS latest, CASE WHEN average >= 0.35 THEN 'very_bullish' WHEN average >= 0.15 THEN 'bullish' WHEN average <= -0.35 THEN 'very_bearish' WHEN average <= -0.15 THEN 'bearish' ELSE 'neutral' END AS label FROM s""")
def sentiment_by_symbol(spark: SparkSession, folder: str) -> DataFrame:
    scored = _articles(spark, folder).where("score IS NOT NULL AND symbol <> ''")
    each = scored.groupBy("symbol").agg(F.count("*").alias("articles"), F.avg("score").alias("average"), F.max_by("score", F.struct("received_at", "article_id")).alias("latest"))
    return each.select("symbol", "articles", F.round("average", 6).alias("average"), F.round("latest", 6).alias("latest"), ladder(F.col("average")).alias("label"))


@R.add(f"""WITH {ONCE}, d AS (SELECT symbol, received_at::DATE::VARCHAR AS day, avg(score) AS score FROM a WHERE score IS NOT NULL AND symbol <> '' GROUP BY 1, 2),
l AS (SELECT *, lag(score) OVER (PARTITION BY symbol ORDER BY day) AS prior, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM d)
SELECT symbol, day, round(score, 6) AS latest, round(score - prior, 6) AS momentum FROM l WHERE r = 1""")
def sentiment_momentum(spark: SparkSession, folder: str) -> DataFrame:
    daily = _articles(spark, folder).where("score IS NOT NULL AND symbol <> ''").groupBy("symbol", F.to_date("received_at").cast("string").alias("day")).agg(F.avg("score").alias("score"))
    by = Window.partitionBy("symbol")
    lagged = daily.withColumn("prior", F.lag("score").over(by.orderBy("day"))).withColumn("r", F.row_number().over(by.orderBy(F.desc("day"))))
    return lagged.where("r = 1").select("symbol", "day", F.round("score", 6).alias("latest"), F.round(F.col("score") - F.col("prior"), 6).alias("momentum"))


@R.add(f"WITH {ONCE} SELECT symbol, arg_max(article_id, (score + relevance, -article_id)) AS article_id, round(max(score + relevance), 6) AS rank_score FROM a WHERE score + relevance IS NOT NULL AND symbol <> '' GROUP BY symbol")
def headline_article(spark: SparkSession, folder: str) -> DataFrame:
    """The article with the most sentiment and relevance of each symbol."""
    scored = _articles(spark, folder).withColumn("s", F.col("score") + F.col("relevance")).where("s IS NOT NULL AND symbol <> ''")
    return scored.groupBy("symbol").agg(F.max_by("article_id", F.struct("s", -F.col("article_id"))).alias("article_id"), F.round(F.max("s"), 6).alias("rank_score"))


@R.add(f"""WITH {ONCE}, t AS (SELECT symbol, lower(trim(sentiment_label)) AS label FROM (SELECT DISTINCT article_id, upper(trim(symbol)) AS symbol, sentiment_label FROM sentiment_articles))
SELECT coalesce(symbol, '') AS symbol, count(*) FILTER (contains(label, 'bull') OR label = 'positive') AS bullish, count(*) FILTER (contains(label, 'bear') OR label = 'negative') AS bearish, count(*) AS n FROM t GROUP BY 1""")
def label_tallies(spark: SparkSession, folder: str) -> DataFrame:
    label = F.lower(F.trim("sentiment_label"))
    once = table(spark, folder, "sentiment_articles").select("article_id", F.upper(F.trim("symbol")).alias("symbol"), "sentiment_label").distinct()
    return once.groupBy(F.coalesce("symbol", F.lit("")).alias("symbol")).agg(F.count_if(label.contains("bull") | (label == "positive")).alias("bullish"), F.count_if(label.contains("bear") | (label == "negative")).alias("bearish"), F.count("*").alias("n"))


@R.add("SELECT source, count(*) AS n FROM (SELECT DISTINCT news_id, trim(source) AS source FROM market_news) WHERE source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "market_news").select("news_id", F.trim("source").alias("source")).distinct().where("source <> ''")
    return once.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@R.add("""WITH n AS (SELECT DISTINCT news_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM market_news),
c AS (SELECT symbol, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS name FROM companies)
SELECT news_id, symbol FROM n JOIN c ON contains(t, name) GROUP BY 1, 2""")
def company_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """News that name a company in full: joined by its first two words in sequence, then compared in full."""
    tokens = tx.ascii_words(F.concat(tx.text_of(F.col("title")), F.lit(" "), tx.text_of(F.col("summary"))))
    news = table(spark, folder, "market_news").select("news_id", tokens.alias("w")).distinct()
    name = tx.ascii_words(F.col("name"))
    firms = table(spark, folder, "companies").select("symbol", name.alias("n")).where(F.size("n") > 0).withColumn("k", F.element_at("n", 1)).withColumn("size", F.size("n"))
    places = news.select("news_id", "w", F.posexplode("w").alias("p", "k"))
    # The table of companies is fixed by the data model.
    found = places.join(F.broadcast(firms), "k").where(F.slice("w", F.col("p") + 1, F.col("size")) == F.col("n"))
    return found.select("news_id", "symbol").distinct()


@R.add("""WITH p AS (SELECT user_id, ts, value AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events WHERE value IS NOT NULL)
SELECT user_id, round(CASE WHEN arg_min(c, -back) FILTER (back <= 5) = 0 THEN 0 ELSE (max(c) FILTER (back = 0) - arg_min(c, -back) FILTER (back <= 5)) / arg_min(c, -back) FILTER (back <= 5) * 100 END, 3) AS one_week,
round(CASE WHEN arg_min(c, -back) FILTER (back <= 21) = 0 THEN 0 ELSE (max(c) FILTER (back = 0) - arg_min(c, -back) FILTER (back <= 21)) / arg_min(c, -back) FILTER (back <= 21) * 100 END, 3) AS one_month FROM p GROUP BY user_id""")
def horizon_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returns of each user's values as a series, in order of time and id."""
    prices = table(spark, folder, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return series.returns(prices, "user_id", "at", "value").select("user_id", F.round("one_week", 3).alias("one_week"), F.round("one_month", 3).alias("one_month"))


@R.add("""WITH r AS (SELECT user_id, ts, event_id, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS r FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM r WHERE r IS NOT NULL)
SELECT u.user_id, round(coalesce(v, 0), 3) AS volatility FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, stddev_pop(r) * sqrt(252) * 100 AS v FROM l WHERE n <= 30 GROUP BY user_id) USING (user_id)""")
def returns_volatility(spark: SparkSession, folder: str) -> DataFrame:
    prices = table(spark, folder, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return series.volatility(prices, "user_id", "at", "value").select("user_id", F.round("volatility", 3).alias("volatility"))


@R.add("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id, event_type")
def event_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@R.add("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Events by a property inside their JSON text."""
    parsed = table(spark, folder, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return parsed.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.add("""SELECT event_type, count(*) FILTER (age <= 1440) AS last_24h, count(*) FILTER (age <= 10080) AS last_7d, count(*) FILTER (age <= 43200) AS last_30d
FROM (SELECT event_type, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') // 60 AS age FROM events) GROUP BY event_type""")
def recency_buckets(spark: SparkSession, folder: str) -> DataFrame:
    age = F.floor(F.timestamp_diff("SECOND", F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit("2024-01-31 00:00:00").cast("timestamp")) / 60)
    aged = table(spark, folder, "events").select("event_type", age.alias("age"))
    return aged.groupBy("event_type").agg(F.count_if(F.col("age") <= 1440).alias("last_24h"), F.count_if(F.col("age") <= 10080).alias("last_7d"), F.count_if(F.col("age") <= 43200).alias("last_30d"))


@R.add("SELECT * FROM (PIVOT (SELECT user_id, event_type FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY user_id)")
def status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@R.add("""SELECT o_orderkey, count(l_linenumber) AS lines, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("lines"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines", "quantity", "revenue")


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@R.add("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose customer is not there."""
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@R.add("""SELECT r_name, n_name, grouping(r_name)::INT AS all_regions, grouping(n_name)::INT AS all_nations, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def region_rollup(spark: SparkSession, folder: str) -> DataFrame:
    # Nations and regions are 25 and 5 rows of the data model.
    places = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, folder, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.grouping("r_name").cast("int").alias("all_regions"), F.grouping("n_name").cast("int").alias("all_nations"), F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


BOTH = """u AS (SELECT lower(trim(url)) AS k, news_id AS id, 0 AS o, title, source, received_at FROM market_news WHERE trim(url) <> '' UNION ALL SELECT lower(trim(url)), article_id, 1, title, source, received_at FROM sentiment_articles WHERE trim(url) <> '')"""


def _both(spark: SparkSession, folder: str) -> DataFrame:
    news = table(spark, folder, "market_news").select(F.lower(F.trim("url")).alias("k"), F.col("news_id").alias("id"), F.lit(0).alias("o"), "title", "source", "received_at")
    other = table(spark, folder, "sentiment_articles").select(F.lower(F.trim("url")).alias("k"), F.col("article_id").alias("id"), F.lit(1).alias("o"), "title", "source", "received_at")
    return news.unionByName(other).where("k <> ''")


@R.add(f"WITH {BOTH} SELECT DISTINCT k AS url FROM u")
def url_union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder).select(F.col("k").alias("url")).distinct()


@R.add(f"WITH {BOTH} SELECT k AS url, arg_min(id, (o, received_at, id)) AS id, min(o) AS o FROM u GROUP BY k")
def url_union_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    kept = merge.first_wins(_both(spark, folder).select("k", "id", "o", "received_at"), ["k"], [F.col("o"), F.col("received_at"), F.col("id")])
    return kept.select(F.col("k").alias("url"), "id", "o")


@R.add(f"""WITH {BOTH} SELECT k AS url, arg_min(title, (o, received_at, id)) FILTER (title <> '') AS title, arg_min(source, (o, received_at, id)) FILTER (source <> '') AS source, max(received_at) AS received_at, bool_or(o = 1) AS scored FROM u GROUP BY k""")
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one address merged field by field."""
    rows = _both(spark, folder).withColumn("scored", F.col("o") == 1)
    merged = merge.merge_fields(rows, "k", F.struct("o", "received_at", "id"), ["title", "source"], ["received_at"], ["scored"], [])
    return merged.withColumnRenamed("k", "url")


@R.add("""WITH a AS (SELECT DISTINCT lower(trim(source)) AS s FROM market_news WHERE trim(source) <> ''), b AS (SELECT DISTINCT lower(trim(source)) AS s FROM sentiment_articles WHERE trim(source) <> '')
SELECT coalesce(a.s, b.s) AS source, a.s IS NOT NULL AS in_news, b.s IS NOT NULL AS in_sentiment FROM a FULL JOIN b ON a.s = b.s""")
def source_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (table(spark, folder, t).select(F.lower(F.trim("source")).alias("source")).where("source <> ''").distinct() for t in ("market_news", "sentiment_articles"))
    return a.withColumn("in_news", F.lit(True)).join(b.withColumn("in_sentiment", F.lit(True)), "source", "full_outer").na.fill(False)


@R.add("SELECT s AS source FROM (SELECT DISTINCT lower(trim(source)) AS s FROM market_news INTERSECT SELECT DISTINCT lower(trim(source)) FROM raw_articles EXCEPT SELECT lower(trim(name)) FROM news_sources)")
def source_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Source names that both tables use and the table of sources does not hold."""
    a, b = (table(spark, folder, t).select(F.lower(F.trim("source")).alias("source")) for t in ("market_news", "raw_articles"))
    return a.intersect(b).subtract(table(spark, folder, "news_sources").select(F.lower(F.trim("name")).alias("source")))


@R.add("""WITH u AS (SELECT c_custkey, c_name, c_acctbal FROM customer), n AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT * FROM n UNION ALL SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def record_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Records with new versions, those of customers with orders, put in place of the old."""
    every = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = every.join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merge.upsert(every, new, ["c_custkey"])


FEATURES = """f AS (SELECT doc_id, least(1.0, coalesce(n_chars, 0) / 2000.0) AS volume, CASE WHEN lang IS NULL THEN 0.0 ELSE 1.0 END AS labelled, CASE WHEN article_id IS NULL THEN 0.0 ELSE 1.0 END AS linked, exp(-coalesce(date_diff('hour', published_at, TIMESTAMP '2025-04-09 00:00:00'), 10000) / 4800.0) AS freshness FROM documents)"""


def _features(spark: SparkSession, folder: str) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", F.col("published_at").cast("timestamp")), F.lit("2025-04-09 00:00:00").cast("timestamp"))
    return table(spark, folder, "documents").select(
        "doc_id", F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 2000.0).alias("volume"), F.when(F.col("lang").isNull(), 0.0).otherwise(1.0).alias("labelled"),
        F.when(F.col("article_id").isNull(), 0.0).otherwise(1.0).alias("linked"), F.exp(-F.coalesce(hours, F.lit(10000)) / 4800.0).alias("freshness"),
    )


@R.add(f"WITH {FEATURES} SELECT doc_id, round(volume, 6) AS volume, labelled, linked, round(freshness, 6) AS freshness FROM f".replace("labelled, linked", "labelled::DOUBLE AS labelled, linked::DOUBLE AS linked"))
def feature_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).withColumn("volume", F.round("volume", 6)).withColumn("freshness", F.round("freshness", 6))


@R.add(f"""WITH {FEATURES}, p AS (SELECT doc_id, 1 / (1 + exp(-(-0.8 + 1.2 * volume + 0.4 * labelled + 0.6 * linked + 0.9 * freshness))) AS score FROM f)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.55 THEN 'promising' WHEN score >= 0.35 THEN 'emerging' ELSE 'weak' END AS label FROM p""")
def logistic_predict(spark: SparkSession, folder: str) -> DataFrame:
    score = model.predict({"volume": 1.2, "labelled": 0.4, "linked": 0.6, "freshness": 0.9}, -0.8)
    return _features(spark, folder).select("doc_id", F.round(score, 6).alias("score"), model.label_of(score).alias("label"))


@R.add()
def logistic_train(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after gradient descent on whether a document is linked; iterative, tested against plain Python."""
    weights, bias = model.train(_features(spark, folder).select(F.round("volume", 2).alias("volume"), "labelled", "linked"), ["volume", "labelled"], "linked", iterations=20)
    return spark.createDataFrame([*weights.items(), ("bias", bias)], "feature string, weight double")


@R.add("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 7) AS mean FROM part GROUP BY CUBE (p_brand, p_type)")
def part_cube(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 7).alias("mean"))

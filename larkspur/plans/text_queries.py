"""Queries of text analysis: words, measures, tone, keywords and co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.operators import cooccurrence as co
from larkspur.operators import vectors
from larkspur.operators.analysis import remainders
from larkspur.plans.registry import Registry
from larkspur.sources.tables import Rounds, release, table

R = Registry()
# Vocabularies of tone, hedging and certainty, and phrases of evidence.
POSITIVE = "advance amazing benefit confident effective efficient excellent favorable good great growth improved innovative leading positive promising successful supportive thriving transformative valuable".split()
NEGATIVE = "alarming bad concern critical crisis decline difficult failure frustrated issue loss negative problem risk setback shortfall struggle trouble uncertain weak worry".split()
HEDGES = "alleged apparently appears assume believe could estimates expected forecast likely maybe might perhaps potentially possibly presumably probable rumor rumour seems suggests uncertain unconfirmed would".split()
ASSERTIVE = "always certainly clearly definitely ensured ensures guaranteed must proves confirmed delivered demonstrates secured undeniably will".split()
EVIDENCE = ["according to", "data from", "evidence from", "research from", "study by", "reported by", "analysis by"]
FIGURE = r"[0-9]+(?:\.[0-9]+)?(?:\s?(?:%|percent|million|billion|thousand|k))?"
ASCII = "regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')"
TOK = f"WITH tok AS (SELECT * FROM (SELECT doc_id, unnest({ASCII}) AS term FROM documents) WHERE term <> '')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _hits(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(words)))


def _kinds(tokens: Column, words: list[str]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))


def tone(score: Column, high: str, low: str, middle: str, above: float, below: float) -> Column:
    return F.when(score >= above, high).when(score <= below, low).otherwise(middle)


def sentiment(tokens: Column, positive: list[str], negative: list[str]) -> tuple[Column, Column]:
    """(positive - negative) / (positive + negative) hits, 0 without any, and its label beyond 0.15."""
    p, n = _hits(tokens, positive), _hits(tokens, negative)
    score = F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)
    return score, F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


@R.add(TOK + f""",
c AS (SELECT doc_id, count(*) FILTER (term IN {_in(POSITIVE)}) AS p, count(*) FILTER (term IN {_in(NEGATIVE)}) AS n FROM tok GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative, CASE WHEN coalesce(p + n, 0) > 0 THEN (p - n) / (p + n)::DOUBLE ELSE 0.0 END AS score FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, positive, negative, round(score, 4) AS score, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM s""")
def sentiment_scores(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.ascii_words(F.col("text"))
    score, label = sentiment(tokens, POSITIVE, NEGATIVE)
    return table(spark, folder, "documents").select("doc_id", _hits(tokens, POSITIVE).cast("bigint").alias("positive"), _hits(tokens, NEGATIVE).cast("bigint").alias("negative"), F.round(score, 4).alias("score"), label.alias("label"))


@R.add(TOK + f""",
c AS (SELECT doc_id, count(DISTINCT term) FILTER (term IN {_in(HEDGES)}) AS h, count(DISTINCT term) FILTER (term IN {_in(ASSERTIVE)}) AS a FROM tok GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN coalesce(h + a, 0) > 0 THEN 0.5 + (a - h) / (h + a)::DOUBLE * 0.5 ELSE 0.5 END AS score FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, round(score, 4) AS score, CASE WHEN score >= 0.65 THEN 'confident' WHEN score <= 0.35 THEN 'cautious' ELSE 'balanced' END AS tone FROM s""")
def certainty_scores(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.ascii_words(F.col("text"))
    h, a = _kinds(tokens, HEDGES), _kinds(tokens, ASSERTIVE)
    score = F.when(h + a > 0, 0.5 + (a - h) / (h + a) * 0.5).otherwise(0.5)
    return table(spark, folder, "documents").select("doc_id", F.round(score, 4).alias("score"), tone(score, "confident", "cautious", "balanced", 0.65, 0.35).alias("tone"))


@R.add(f"""
WITH v AS (SELECT doc_id, (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{FIGURE}')) AS x)) + {" + ".join(f"contains(lower(coalesce(text, '')), '{e}')::INT" for e in EVIDENCE)}
  + (SELECT count(DISTINCT y) FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s)]+')) AS y)) AS e,
  len(list_filter({_in(HEDGES).replace('(', '[').replace(')', ']')}, lambda h: list_contains({ASCII}, h))) AS s FROM documents),
f AS (SELECT doc_id, e AS evidence, s AS speculative, CASE WHEN e + s > 0 THEN 0.5 + (e - s) / (e + s)::DOUBLE * 0.5 ELSE 0.5 END AS score FROM v)
SELECT doc_id, evidence, speculative, round(score, 4) AS score, CASE WHEN score >= 0.65 THEN 'factual' WHEN score <= 0.35 THEN 'speculative' ELSE 'opinion' END AS classification FROM f""")
def factuality(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct verifiable figures, links and evidence phrases against distinct hedges."""
    text, tokens = tx.text_of(F.col("text")), tx.ascii_words(F.col("text"))

    def kinds(pattern: str) -> Column:
        return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))

    said = reduce(lambda a, b: a + b, [F.lower(text).contains(e).cast("int") for e in EVIDENCE])
    e = kinds(FIGURE) + said + kinds(r"https?://[^\s)]+")
    s = _kinds(tokens, HEDGES)
    score = F.when(e + s > 0, 0.5 + (e - s) / (e + s) * 0.5).otherwise(0.5)
    return table(spark, folder, "documents").select("doc_id", e.cast("bigint").alias("evidence"), s.cast("bigint").alias("speculative"), F.round(score, 4).alias("score"), tone(score, "factual", "speculative", "opinion", 0.65, 0.35).alias("classification"))


READ = f"""
WITH w AS (SELECT doc_id, len(list_filter({ASCII}, lambda x: x <> '')) AS words,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS sents,
  coalesce(list_sum(list_transform(list_filter({ASCII}, lambda x: x <> ''), lambda x: greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(x, '[^a-z]', '', 'g'), 'e$', ''), '[aeiouy]+'))))), 0) AS syl FROM documents),
r AS (SELECT doc_id, greatest(1, words)::DOUBLE / greatest(1, sents) AS asl, greatest(1, syl)::DOUBLE / greatest(1, words) AS asw FROM w),
e AS (SELECT doc_id, 206.835 - 1.015 * asl - 84.6 * asw AS ease, 0.39 * asl + 11.8 * asw - 15.59 AS grade FROM r)
"""


@R.add(READ + """SELECT doc_id, round(ease, 3) AS ease, round(grade, 3) AS grade, round(least(1.0, greatest(0.0, (ease + 20) / 140)), 6) AS score,
CASE WHEN ease >= 70 THEN 'clear' WHEN ease >= 60 THEN 'accessible' WHEN ease >= 50 THEN 'moderate' WHEN ease < 40 THEN 'dense' ELSE 'challenging' END AS label FROM e""")
def readability(spark: SparkSession, folder: str) -> DataFrame:
    """Reading ease and grade from words a sentence and syllables a word."""
    tokens = tx.ascii_words(F.col("text"))
    counted = table(spark, folder, "documents").select("doc_id", F.size(tokens).alias("w"), F.size(tx.sentences(F.col("text"))).alias("s"), F.aggregate(tokens, F.lit(0), lambda a, t: a + tx.syllables(t)).alias("y"))
    asl, asw = F.greatest(F.lit(1), F.col("w")) / F.greatest(F.lit(1), F.col("s")), F.greatest(F.lit(1), F.col("y")) / F.greatest(F.lit(1), F.col("w"))
    ease, grade = 206.835 - 1.015 * asl - 84.6 * asw, 0.39 * asl + 11.8 * asw - 15.59
    label = F.when(ease >= 70, "clear").when(ease >= 60, "accessible").when(ease >= 50, "moderate").when(ease < 40, "dense").otherwise("challenging")
    return counted.select("doc_id", F.round(ease, 3).alias("ease"), F.round(grade, 3).alias("grade"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ease + 20) / 140)), 6).alias("score"), label.alias("label"))


@R.add(TOK + """, c AS (SELECT doc_id, term, count(*) AS n FROM tok WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY doc_id, term),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c)
SELECT doc_id, rank::INT AS rank, term, n FROM r WHERE rank <= 5""")
def keyword_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent words of each document."""
    tokens = table(spark, folder, "documents").select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("term")).where((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$"))
    ranked = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")))
    return ranked.where("rank <= 5").select("doc_id", "rank", "term", "n")


@R.add(TOK + """, c AS (SELECT doc_id, term, count(*) AS n FROM tok WHERE length(term) >= 4 GROUP BY doc_id, term)
SELECT doc_id, term, round(least(1.0, greatest(0.05, 0.35 + 4.2 * n / sum(n) OVER (PARTITION BY doc_id) + CASE WHEN length(term) >= 8 THEN 0.1 ELSE 0 END)), 6) AS weight FROM c""")
def semantic_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of each word in its document by share and length."""
    tokens = table(spark, folder, "documents").select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("term")).where(F.length("term") >= 4)
    counted = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    share = 4.2 * F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))
    weight = 0.35 + share + F.when(F.length("term") >= 8, 0.1).otherwise(0.0)
    return counted.select("doc_id", "term", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), weight)), 6).alias("weight"))


@R.add("""WITH l AS (SELECT doc_id, lower(trim(line)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY doc_id, line)
SELECT doc_id, sum(n)::BIGINT AS lines, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE, 6) AS density FROM c GROUP BY doc_id""")
def repeated_lines_density(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).where("line <> ''")
    counted = lines.groupBy("doc_id", F.xxhash64("line").alias("h"), F.length("line").alias("k")).agg(F.count("*").alias("n"))
    rep = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return counted.groupBy("doc_id").agg(F.sum("n").alias("lines"), rep.alias("repeated"), F.round(rep / F.sum("n"), 6).alias("density"))


@R.add(TOK + """ SELECT doc_id, count(*) AS words, count(DISTINCT term) AS kinds, round(count(DISTINCT term) / count(*)::DOUBLE, 6) AS ratio FROM tok GROUP BY doc_id""")
def type_token_ratios(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.ascii_words(F.col("text"))
    return table(spark, folder, "documents").where(F.size(tokens) > 0).select("doc_id", F.size(tokens).cast("bigint").alias("words"), F.size(F.array_distinct(tokens)).cast("bigint").alias("kinds"), F.round(tx.type_token_ratio(tokens), 6).alias("ratio"))


@R.add("""SELECT doc_id, list_max(list_transform(y, lambda x: x::INT)) AS year FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9][0-9]')) AS y FROM documents) WHERE len(y) > 0""")
def latest_years(spark: SparkSession, folder: str) -> DataFrame:
    """The latest year of each text that names one."""
    return table(spark, folder, "documents").select("doc_id", tx.latest_year(F.col("text")).alias("year")).where("year IS NOT NULL")


@R.add("""SELECT acronym, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9_\\pL])([A-Z]{2,5})(?:[ ,.;:)])', 1)) AS acronym FROM documents) GROUP BY acronym""")
def acronym_counts(spark: SparkSession, folder: str) -> DataFrame:
    text = tx.text_of(F.col("text"))
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_\p{L}])([A-Z]{2,5})(?:[ ,.;:)])"), 1)).alias("acronym"))
    return found.groupBy("acronym").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@R.add("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS sentences, CASE WHEN len(s) > 0 THEN list_max(list_transform(s, lambda x: length(x)))::INT END AS longest FROM s""")
def sentence_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = tx.sentences(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(found).alias("sentences"), F.array_max(F.transform(found, F.length)).alias("longest"))


@R.add(f"""WITH t AS (SELECT news_id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT news_id, title FROM market_news)),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM t WHERE len(w) > 1)
SELECT bigram, count(*) AS n FROM b GROUP BY bigram HAVING count(*) >= 3""")
def title_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "market_news").select("news_id", "title").distinct()
    return titles.select(F.explode(tx.bigrams(tx.words(F.col("title")))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 3")


COOC = """WITH t AS (SELECT news_id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT news_id, title FROM market_news)),
p AS (SELECT news_id, i, w[i] AS x FROM (SELECT news_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
c AS (SELECT a.x AS target, b.x AS context, sum(1.0::DOUBLE / abs(a.i - b.i)) AS weight FROM p a JOIN p b ON a.news_id = b.news_id AND abs(a.i - b.i) BETWEEN 1 AND 2 GROUP BY 1, 2)
"""


def _cooc(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "market_news").select("news_id", "title").distinct()
    return co.cooccurrence(titles.select("news_id", tx.words(F.col("title")).alias("w")), "news_id", "w", 2)


@R.add(COOC + "SELECT target, context, round(weight, 6) AS weight FROM c")
def cooccurrence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _cooc(spark, folder).select("target", "context", F.round("weight", 6).alias("weight"))


PPMI = COOC + """, r AS (SELECT target, sum(weight) AS r FROM c GROUP BY 1), k AS (SELECT context, sum(weight) AS k FROM c GROUP BY 1), n AS (SELECT sum(weight) AS n FROM c),
m AS (SELECT target, context, ln(weight * n / (r * k)) AS ppmi FROM c JOIN r USING (target) JOIN k USING (context), n WHERE ln(weight * n / (r * k)) > 0)
"""


@R.add(PPMI + "SELECT target, context, round(ppmi, 5) AS ppmi FROM m WHERE ppmi > 0.001")
def ppmi(spark: SparkSession, folder: str) -> DataFrame:
    return co.ppmi(_cooc(spark, folder)).where("ppmi > 0.001").select("target", "context", F.round("ppmi", 5).alias("ppmi"))


@R.add(PPMI + """, v AS (SELECT target, sqrt(sum(ppmi * ppmi)) AS norm FROM m GROUP BY 1),
s AS (SELECT a.target AS l, b.target AS r, sum(a.ppmi * b.ppmi) AS dot FROM m a JOIN m b ON a.context = b.context AND a.target < b.target GROUP BY 1, 2)
SELECT l AS left, r AS right, round(dot / (x.norm * y.norm), 5) AS score FROM s JOIN v x ON x.target = l JOIN v y ON y.target = r WHERE dot / (x.norm * y.norm) >= 0.5 ORDER BY round(dot / (x.norm * y.norm), 9) DESC, l, r LIMIT 100""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def ppmi_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most similar pairs of words."""
    words = table(spark, folder, "market_news").select("news_id", "title").distinct().select("news_id", tx.words(F.col("title")).alias("w"))
    # Words are 64-bit hashes until the pairs are few.
    hashed = words.select("news_id", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    names = words.select(F.explode("w").alias("name")).distinct().select(F.xxhash64("name").alias("target"), "name")
    rounds = Rounds(spark, "ppmi")
    counts = rounds.next(co.cooccurrence(hashed, "news_id", "w", 2))
    release(spark)
    weighed = rounds.next(co.ppmi(counts))
    release(spark)
    pairs = co.most_similar(weighed, "target", "context", "ppmi", names, 100, 0.5)
    return pairs.select("left", "right", F.round("score", 5).alias("score"))


@R.add("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT q, rank::INT AS rank, vec_id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def embedding_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, against all."""
    best = vectors.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)
    return best.select(F.col("query").alias("q"), "rank", "vec_id", F.round("score", 5).alias("score"))


@R.add("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\?'))::INT AS questions, len(regexp_extract_all(coalesce(text, ''), '"[^"\\n]+"'))::INT AS quotes, coalesce(regexp_matches(lower(text), '(said|told|wrote|says)'), false) AS dialogue FROM documents""")
def conversation_signals(spark: SparkSession, folder: str) -> DataFrame:
    text = tx.text_of(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.regexp_count(text, F.lit(r"\?")).alias("questions"), F.regexp_count(text, F.lit('"[^"\\n]+"')).alias("quotes"), F.lower(text).rlike("(said|told|wrote|says)").alias("dialogue"))


@R.add("""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS known FROM companies), t AS (SELECT DISTINCT * FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+')) AS term FROM market_news) WHERE length(term) >= 4)
SELECT term, known, levenshtein(term, known)::INT AS distance FROM t JOIN w ON length(known) >= 4 AND levenshtein(term, known) BETWEEN 1 AND 2""")
def levenshtein_fuzzy_join(spark: SparkSession, folder: str) -> DataFrame:
    """Words of titles one or two edits from a word of a company's name, from four letters on, wherever the edits are."""
    known = table(spark, folder, "companies").select(F.explode(tx.ascii_words(F.col("name"))).alias("known")).where(F.length("known") >= 4).distinct()
    terms = table(spark, folder, "market_news").select(F.explode(tx.ascii_words(F.col("title"))).alias("term")).where(F.length("term") >= 4).distinct()
    near = remainders(terms, "term", "term").join(remainders(known, "known", "known"), "_k").select("term", "known").distinct()
    return near.withColumn("distance", F.levenshtein("term", "known", 2)).where("distance BETWEEN 1 AND 2")


@R.add("""WITH s AS (SELECT * FROM (VALUES ('the'), ('and'), ('of'), ('to'), ('in'), ('a')) v(w)), t AS (SELECT * FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+')) AS term FROM market_news) WHERE term <> '')
SELECT term, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.w = t.term) GROUP BY term""")
def stopword_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in ("the", "and", "of", "to", "in", "a")], "term string")
    terms = table(spark, folder, "market_news").select(F.explode(tx.ascii_words(F.col("title"))).alias("term"))
    # Six literal rows.
    return terms.join(F.broadcast(stop), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


@R.add("""WITH c AS (SELECT DISTINCT article_id, lower(trim(e)) AS e FROM (SELECT id AS article_id, unnest(entities) AS e FROM raw_articles) WHERE trim(e) <> ''),
f AS (SELECT e, count(*) AS f FROM c GROUP BY e), p AS (SELECT a.e AS l, b.e AS r, count(*) AS n FROM c a JOIN c b ON a.article_id = b.article_id AND a.e < b.e GROUP BY 1, 2)
SELECT l AS entity, r AS related, n, round(least(1.0, n / sqrt(x.f * y.f)), 6) AS score FROM p JOIN f x ON x.e = l JOIN f y ON y.e = r WHERE n >= 2 AND n / sqrt(x.f * y.f) >= 0.2""")
def related_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that come together in at least two articles, by w / sqrt(f1 f2) of 0.2 or more."""
    each = table(spark, folder, "raw_articles").select("id", F.explode("entities").alias("e")).select("id", F.lower(F.trim("e")).alias("e")).where("e <> ''").distinct()
    freq = each.groupBy("e").agg(F.count("*").alias("f")).where("f >= 2")
    each = each.join(freq, "e")
    a, b = each.select("id", F.col("e").alias("entity"), F.col("f").alias("fa")), each.select("id", F.col("e").alias("related"), F.col("f").alias("fb"))
    pairs = a.join(b, "id").where("entity < related").groupBy("entity", "related").agg(F.count("*").alias("n"), F.first("fa").alias("fa"), F.first("fb").alias("fb"))
    raw = F.col("n") / F.sqrt(F.col("fa") * F.col("fb"))
    return pairs.where((F.col("n") >= 2) & (raw >= 0.2)).select("entity", "related", "n", F.round(F.least(F.lit(1.0), raw), 6).alias("score"))

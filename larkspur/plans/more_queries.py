"""Further queries: expansion, resolution, histories, ranking by several signals, lines and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.functions.variants import term_variants, verb_forms
from larkspur.operators import graph
from larkspur.plans.graph_queries import DOM, LINKS, RULES, TRIPLES, _ledger, _triples
from larkspur.plans.registry import Registry
from larkspur.plans.search_queries import AS_OF, minutes_since
from larkspur.sources.tables import table

R = Registry()


@R.add("""WITH t AS (SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) >= 6),
c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c) WHERE r <= 8)
SELECT a.w AS left_word, b.w AS right_word, round(sum(sqrt(a.n * b.n)), 6) AS weight, count(*) AS docs FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY 1, 2 HAVING count(*) >= 3""")
def keyword_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of each document's eight keywords, by the sum of sqrt(c1 c2), where at least three documents have both."""
    words = table(spark, folder, "documents").select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("w")).where(F.length("w") >= 6).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    best = graph.top_each(words, ["doc_id"], [F.desc("n"), F.col("w")], 8)
    a, b = best.select("doc_id", F.col("w").alias("left_word"), F.col("n").alias("x")), best.select("doc_id", F.col("w").alias("right_word"), F.col("n").alias("y"))
    pairs = a.join(b, "doc_id").where("left_word < right_word").groupBy("left_word", "right_word").agg(F.round(F.sum(F.sqrt(F.col("x") * F.col("y"))), 6).alias("weight"), F.count("*").alias("docs"))
    return pairs.where("docs >= 3").select("left_word", "right_word", "weight", "docs")


@R.add("""WITH q AS (SELECT DISTINCT lower(trim(source)) AS name FROM market_news WHERE trim(source) <> ''), s AS (SELECT source_id, lower(trim(name)) AS n, list_transform(aliases, lambda a: lower(trim(a))) AS al FROM news_sources),
x AS (SELECT q.name, (SELECT min(source_id) FROM s WHERE s.n = q.name) AS exact, (SELECT min(source_id) FROM s WHERE list_contains(al, q.name)) AS alias FROM q)
SELECT name, coalesce(exact, alias) AS source_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM x""")
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Written source names resolved by name, else by alias."""
    asked = table(spark, folder, "market_news").select(F.lower(F.trim("source")).alias("name")).where("name <> ''").distinct()
    sources = table(spark, folder, "news_sources")
    exact = sources.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("source_id").alias("exact"))
    alias = sources.select("source_id", F.explode("aliases").alias("a")).groupBy(F.lower(F.trim("a")).alias("name")).agg(F.min("source_id").alias("alias"))
    both = asked.join(exact, "name", "left").join(alias, "name", "left")
    return both.select("name", F.coalesce("exact", "alias").alias("source_id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").otherwise("none").alias("how"))


@R.add("""WITH w AS (SELECT * FROM (VALUES (0, 'X999'), (1, (SELECT max(symbol) FROM companies)), (2, (SELECT min(symbol) FROM companies))) v(p, s))
SELECT symbol, row_number() OVER (ORDER BY p NULLS LAST, symbol) AS place FROM companies LEFT JOIN w ON s = symbol ORDER BY place LIMIT 10""")
def ordered_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Requested companies first, in the order requested, then the others by symbol."""
    firms = table(spark, folder, "companies")
    ends = firms.agg(F.array(F.lit("X999"), F.max("symbol"), F.min("symbol")).alias("a")).select(F.posexplode("a").alias("p", "symbol"))
    # Three requested symbols.
    joined = firms.join(F.broadcast(ends), "symbol", "left").orderBy(F.asc_nulls_last("p"), "symbol").limit(10)
    return joined.select("symbol", F.row_number().over(Window.orderBy(F.asc_nulls_last("p"), "symbol")).alias("place"))


@R.add(LINKS + """, t AS (SELECT lower(name) AS src, max(trust_score) AS t FROM news_sources GROUP BY 1),
p AS (SELECT dst, sum(count) AS inbound, count(DISTINCT src) AS sources, least(1.0, greatest(0.0, 0.52 + least(0.25, 0.05 * count(DISTINCT src)) + least(0.4, ln(1 + sum(coalesce(t, 0.52) * ln(1 + count))) / 3))) AS a FROM g LEFT JOIN t USING (src) GROUP BY dst),
d AS (SELECT split_part(dst, '.', -1) AS zone, count(*) AS pages, avg(a) AS mean, sum(inbound)::BIGINT AS inbound, max(sources) AS sources, arg_max(dst, (a, dst)) AS top FROM p GROUP BY 1)
SELECT zone, pages, inbound, top, round(mean, 6) AS mean, round(least(1.0, 0.52 + mean * 0.4 + least(0.25, 0.05 * sources) + CASE WHEN pages > 1 THEN least(0.15, ln(1 + pages) / 3) ELSE 0 END), 6) AS authority FROM d""")
def zone_authority(spark: SparkSession, folder: str) -> DataFrame:
    """Authority rolled up to the domains' last label, with the best page of each."""
    from larkspur.operators import links

    trust = table(spark, folder, "news_sources").groupBy(F.lower("name").alias("src")).agg(F.max("trust_score").alias("t"))
    pages = links.page_authority(_ledger(spark, folder).join(F.broadcast(trust), "src", "left"), F.coalesce("t", F.lit(links.BASELINE)), F.lit(links.BASELINE))
    each = pages.groupBy(F.substring_index("dst", ".", -1).alias("zone")).agg(F.count("*").alias("pages"), F.avg("authority").alias("m"), F.sum("inbound").alias("inbound"), F.max("sources").alias("s"), F.max_by("dst", F.struct("authority", "dst")).alias("top"))
    score = links.BASELINE + F.col("m") * 0.4 + F.least(F.lit(0.25), 0.05 * F.col("s")) + F.when(F.col("pages") > 1, F.least(F.lit(0.15), F.log1p("pages") / 3)).otherwise(0.0)
    return each.select("zone", "pages", "inbound", "top", F.round("m", 6).alias("mean"), F.round(F.least(F.lit(1.0), score), 6).alias("authority"))


@R.add("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, count(value) AS points, round(arg_max(value, n), 4) AS oldest, round(arg_min(value, n), 4) AS newest, round(max(value), 4) AS highest FROM r WHERE n <= 30 GROUP BY user_id""")
def sparklines(spark: SparkSession, folder: str) -> DataFrame:
    """The last thirty values of each user as points of a small chart: their number, first, last and highest."""
    last = graph.top_each(table(spark, folder, "events").select("user_id", "value", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30)
    return last.groupBy("user_id").agg(F.count("value").alias("points"), F.round(F.max_by("value", "rank"), 4).alias("oldest"), F.round(F.min_by("value", "rank"), 4).alias("newest"), F.round(F.max("value"), 4).alias("highest"))


@R.add(f"""WITH p AS (SELECT {DOM} AS page, id, row_number() OVER (PARTITION BY {DOM} ORDER BY received_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY {DOM}) AS versions FROM raw_articles WHERE trim(coalesce(url, '')) <> '')
SELECT page, max(versions) AS versions, array_to_string(list(id ORDER BY n), ',') AS latest FROM p WHERE n <= 8 GROUP BY page""")
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each domain's eight latest articles, newest first, with the number of all."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(urls.domain(F.col("url")).alias("page"), "id", "received_at")
    last = graph.top_each(pages, ["page"], [F.desc("received_at"), F.desc("id")], 8).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("latest"))
    return last.join(pages.groupBy("page").agg(F.count("*").alias("versions")), "page").select("page", "versions", "latest")


@R.add("""WITH g AS (SELECT source_id, list_concat([lower(trim(name))], list_transform(aliases, lambda a: lower(trim(a)))) AS m FROM news_sources), q AS (SELECT * FROM (VALUES ('drapaex ledger'), ('the starkul dispatch'), ('nobody')) v(t))
SELECT t AS term, x AS synonym, 0.85::DOUBLE AS weight FROM (SELECT t, unnest(m) AS x FROM q JOIN g ON list_contains(m, t)) WHERE x <> t GROUP BY ALL""")
def synonym_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """The other names of every group that holds a query term."""
    names = table(spark, folder, "news_sources").select("source_id", F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select("source_id", F.lower(F.trim("n")).alias("synonym"))
    asked = names.where(F.col("synonym").isin("drapaex ledger", "the starkul dispatch", "nobody")).select("source_id", F.col("synonym").alias("term"))
    return asked.join(names, "source_id").where("synonym <> term").select("term", "synonym", F.lit(0.85).alias("weight")).distinct()


@R.add("""SELECT doc_id, variant, max(weight)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents) t JOIN (VALUES ('merger', 1.0), ('merg', 0.75), ('mergers', 0.8), ('delay', 1.0), ('delaies', 0.88), ('delays', 0.8), ('dispute', 1.0), ('disputes', 0.8)) v(variant, weight) ON t.w = v.variant GROUP BY 1, 2""")
def term_variant_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a variant of a query word, with its weight."""
    weights = {v: w for t in ("merger", "delay", "dispute") for v, w in term_variants(t).items()}
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.array_intersect(tx.ascii_words(F.col("text")), F.array(*[F.lit(v) for v in weights]))).alias("variant"))
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return found.select("doc_id", "variant", known[F.col("variant")].alias("weight"))


VERBS = ["approve", "delay", "sell", "hire", "cut", "carry"]


@R.add(f"SELECT verb, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents) t JOIN (VALUES {', '.join(f'''('{f}', '{v}')''' for v in VERBS for f in verb_forms(v))}) v(form, verb) ON w = form GROUP BY verb")
def verb_form_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that use a form of each verb."""
    words = tx.ascii_words(F.col("text"))
    hits = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(f) for f in verb_forms(v)])), F.lit(v)) for v in VERBS]))
    return table(spark, folder, "documents").select("doc_id", F.explode(hits).alias("verb")).groupBy("verb").agg(F.count_distinct("doc_id").alias("docs"))


NAVIGATION = ["home", "companies", "newsletter", "opinion", "sign in", "markets", "cookie settings", "all rights reserved", "read more", "subscribe for updates", "story continues below"]
LINE = "lower(trim(line))"


@R.add(f"""WITH l AS (SELECT doc_id, {LINE} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
b AS (SELECT doc_id, line, list_contains({NAVIGATION!r}, line) OR contains(line, ' | ') OR NOT regexp_matches(line, '\\p{{L}}') AS flag FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (flag) AS boilerplate, round(count(*) FILTER (flag) / count(*)::DOUBLE, 6) AS density FROM b GROUP BY doc_id""")
def boilerplate_density(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a document's lines that are navigation, bars of links, or without letters."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).where(F.col("line") != "")
    flag = F.col("line").isin(NAVIGATION) | F.col("line").contains(" | ") | ~F.col("line").rlike(r"\p{L}")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(flag).alias("boilerplate"), F.round(F.count_if(flag) / F.count("*"), 6).alias("density"))


@R.add("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'error' WHEN doc_type = 'report' THEN 'document' WHEN contains(text, ' | ') OR n_chars < 200 THEN 'non_article' WHEN published_at IS NOT NULL OR n_chars >= 600 THEN 'article' ELSE 'page' END AS content_type FROM documents""")
def content_types(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.trim(tx.text_of(F.col("text"))) == "", "error").when(F.col("doc_type") == "report", "document").when(F.col("text").contains(" | ") | (F.col("n_chars") < 200), "non_article").when(F.col("published_at").isNotNull() | (F.col("n_chars") >= 600), "article").otherwise("page")
    return table(spark, folder, "documents").select("doc_id", kind.alias("content_type"))


SPECULATIVE = ["may", "could", "might", "possibly"]


@R.add(TRIPLES + f""", c AS (SELECT e.*, s.s FROM e JOIN s USING (id) WHERE contains(lower(s.s), split_part(e.subject, ' ', 1)))
SELECT subject, relation, object, round(max(least(1.0, greatest(0.0, confidence + CASE WHEN regexp_matches(s, '[0-9]') THEN 0.1 ELSE 0 END - CASE WHEN {" OR ".join(f"contains(lower(s), ' {w} ')" for w in SPECULATIVE)} THEN 0.2 ELSE 0 END - CASE WHEN subject = object THEN 0.2 ELSE 0 END))), 4) AS confidence FROM c GROUP BY 1, 2, 3""")
def relation_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of each triple by its sentences: figures raise it, speculation and self-relation lower it."""
    said = table(spark, folder, "raw_articles").select("id", F.explode(F.split(tx.text_of(F.col("lede")), "[.!?]+")).alias("s"))
    found = graph.pattern_triples(said, "s", RULES).drop("s").join(said, "id").where(F.lower("s").contains(F.substring_index("subject", " ", 1)))
    unsure = reduce(lambda a, b: a | b, [F.lower("s").contains(f" {w} ") for w in SPECULATIVE])
    score = F.col("confidence") + F.when(F.col("s").rlike("[0-9]"), 0.1).otherwise(0.0) - F.when(unsure, 0.2).otherwise(0.0) - F.when(F.col("subject") == F.col("object"), 0.2).otherwise(0.0)
    return found.groupBy("subject", "relation", "object").agg(F.round(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))), 4).alias("confidence"))


@R.add(TRIPLES + """, h AS (SELECT subject, relation, object, confidence FROM e WHERE id % 2 = 0), n AS (SELECT subject, relation, object, confidence FROM e WHERE id % 2 = 1)
SELECT subject, relation, object, max(confidence) AS confidence, sum(m)::BIGINT AS mentions FROM (SELECT *, 1 AS m FROM h UNION ALL SELECT *, 1 FROM n) GROUP BY 1, 2, 3""")
def incremental_triples(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of triples extended by new ones: merged statistics are merged again, nothing is read twice."""
    every = _triples(spark, folder)
    old, new = graph.merged(every.where("id % 2 = 0")), graph.merged(every.where("id % 2 = 1"))
    return old.unionByName(new).groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"))


@R.add(TRIPLES + """, r AS (SELECT subject AS entity, 1 AS o, 0 AS i, relation FROM e UNION ALL SELECT object, 0, 1, relation FROM e), a AS (SELECT entity, sum(o) AS outgoing, sum(i) AS incoming, count(DISTINCT relation) AS relations FROM r GROUP BY entity),
sc AS (SELECT entity, outgoing, incoming, round((least(1.0, relations / 4.0) + least(1.0, (outgoing + incoming) / 12.0) + ln(1 + incoming) / ln(1 + max(incoming) OVER ()) + least(1.0, outgoing / 3.0)) / 4, 6) AS score FROM a)
SELECT entity, score, (outgoing + incoming)::BIGINT AS facts FROM sc ORDER BY score DESC, facts DESC, entity LIMIT 25""")
def entity_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 best entities by the mean of four signals, then facts, then name."""
    each = graph.authority(_triples(spark, folder))
    facts = F.col("incoming") + F.col("outgoing")
    score = (F.least(F.lit(1.0), F.col("relations") / 4.0) + F.least(F.lit(1.0), facts / 12.0) + F.col("authority") + F.least(F.lit(1.0), F.col("outgoing") / 3.0)) / 4
    return each.select("entity", F.round(score, 6).alias("score"), facts.alias("facts")).orderBy(F.desc("score"), F.desc("facts"), "entity").limit(25)


@R.add("""WITH s AS (SELECT doc_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {'p': i, 's': x[i]})) AS u FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+') AS x FROM documents)),
m AS (SELECT doc_id, w, min(u.p) AS p FROM s, (VALUES ('merger'), ('energy'), ('dividend')) v(w) WHERE contains(lower(u.s), w) GROUP BY 1, 2)
SELECT m.doc_id, m.w AS keyword, 'What does the text say about ' || m.w || '?' AS question, trim(regexp_replace(s.u.s, '\\s+', ' ', 'g')) AS answer FROM m JOIN s ON s.doc_id = m.doc_id AND s.u.p = m.p""")
def question_answers(spark: SparkSession, folder: str) -> DataFrame:
    """For each keyword of a text the question about it and the first sentence that answers."""
    parts = table(spark, folder, "documents").select("doc_id", F.split(tx.text_of(F.col("text")), "[.!?]+").alias("x"))
    asked = parts.select("doc_id", "x", F.explode(F.array(*[F.lit(w) for w in ("merger", "energy", "dividend")])).alias("keyword"))
    first = F.element_at(F.filter("x", lambda s: F.lower(s).contains(F.col("keyword"))), 1)
    kept = asked.where(F.exists("x", lambda s: F.lower(s).contains(F.col("keyword"))))
    return kept.select("doc_id", "keyword", F.concat(F.lit("What does the text say about "), "keyword", F.lit("?")).alias("question"), tx.squeezed(first).alias("answer"))


@R.add("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id, regexp_extract(line, '^@?([A-Za-z][A-Za-z ]{1,30}): (.+)$', 1) AS speaker, count(*) AS turns FROM l WHERE regexp_matches(line, '^@?[A-Za-z][A-Za-z ]{1,30}: [^\\r]+$') GROUP BY 1, 2""")
def speaker_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the form Speaker: text, counted by speaker."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split(tx.text_of(F.col("text")), "\n")).alias("line")).where(F.col("line").rlike(r"^@?[A-Za-z][A-Za-z ]{1,30}: [^\r]+\z"))
    return lines.groupBy("doc_id", F.regexp_extract("line", r"^@?([A-Za-z][A-Za-z ]{1,30}): (.+)$", 1).alias("speaker")).agg(F.count("*").alias("turns"))


@R.add(f"""WITH p AS (SELECT {DOM} AS domain, max(received_at) AS last, count(*) AS n FROM raw_articles WHERE trim(coalesce(url, '')) <> '' GROUP BY 1), t AS (SELECT domain, max(trust_score) AS t FROM news_sources GROUP BY 1)
SELECT p.domain, round(coalesce(t, 0.52) + least(0.3, n / 1000.0) + CASE WHEN greatest(0, date_diff('second', last, TIMESTAMP '{AS_OF}')) // 60 > 1440 THEN 0.3 ELSE 0.1 END, 6) AS priority FROM p LEFT JOIN t ON t.domain = p.domain ORDER BY priority DESC, p.domain LIMIT 60""")
def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """The sixty domains to visit first, by trust, volume and age."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.max("received_at").alias("last"), F.count("*").alias("n"))
    trust = table(spark, folder, "news_sources").groupBy("domain").agg(F.max("trust_score").alias("t"))
    score = F.coalesce("t", F.lit(0.52)) + F.least(F.lit(0.3), F.col("n") / 1000.0) + F.when(minutes_since(F.col("last")) > 1440, 0.3).otherwise(0.1)
    return pages.join(trust, "domain", "left").select("domain", F.round(score, 6).alias("priority")).orderBy(F.desc("priority"), "domain").limit(60)


@R.add(LINKS + """, r AS (SELECT src, dst, coalesce(t, 0.52) AS trust, count, row_number() OVER (PARTITION BY src ORDER BY coalesce(t, 0.52) DESC, count DESC, dst) AS n FROM g LEFT JOIN (SELECT domain, max(trust_score) AS t FROM news_sources GROUP BY 1) x ON x.domain = dst WHERE coalesce(t, 0.52) >= 0.6)
SELECT src, n AS rank, dst, trust FROM r WHERE n <= 5""")
def source_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five trusted domains that each source points to."""
    trust = table(spark, folder, "news_sources").groupBy(F.col("domain").alias("dst")).agg(F.max("trust_score").alias("t"))
    led = _ledger(spark, folder).join(trust, "dst", "left").withColumn("trust", F.coalesce("t", F.lit(0.52))).where("trust >= 0.6")
    return graph.top_each(led, ["src"], [F.desc("trust"), F.desc("count"), F.col("dst")], 5).select("src", "rank", "dst", "trust")


def signal_score(text: Column, title: Column, terms: list[str], phrases: dict[str, float]) -> Column:
    """Points for phrases, neighbouring terms, terms in the title and terms in the text."""
    words, low = tx.ascii_words(text), F.lower(tx.text_of(text))
    pairs = tx.bigrams(words)
    parts: list[Column] = [F.when(low.contains(p), 6.0 * w).otherwise(0.0) for p, w in phrases.items()]
    parts += [F.when(F.array_contains(pairs, f"{a} {b}"), 4.4 * 0.72).otherwise(0.0) for a, b in zip(terms, terms[1:])]
    parts += [F.when(F.array_contains(tx.ascii_words(title), t), 3.4).otherwise(0.0) + F.when(F.array_contains(words, t), 1.2).otherwise(0.0) for t in terms]
    return reduce(lambda a, b: a + b, parts)


A = "list_contains(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), '{1}')"
JOINED = "(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(lede, '')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ')"


@R.add(f"""SELECT id, round(CASE WHEN contains(lower(coalesce(lede, '')), 'supply deal') THEN 6.0 ELSE 0 END + CASE WHEN contains({JOINED}, ' supply deal ') THEN 4.4 * 0.72 ELSE 0 END
 + CASE WHEN {A.format('title', 'supply')} THEN 3.4 ELSE 0 END + CASE WHEN {A.format('lede', 'supply')} THEN 1.2 ELSE 0 END + CASE WHEN {A.format('title', 'deal')} THEN 3.4 ELSE 0 END + CASE WHEN {A.format('lede', 'deal')} THEN 1.2 ELSE 0 END, 4)::DOUBLE AS score
FROM raw_articles ORDER BY score DESC, id LIMIT 40""")
def signal_search(spark: SparkSession, folder: str) -> DataFrame:
    """The forty best articles for a query by phrase, bigram, title and text signals."""
    score = signal_score(F.col("lede"), F.col("title"), ["supply", "deal"], {"supply deal": 1.0})
    return table(spark, folder, "raw_articles").select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(40)


@R.add("""WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT user_id, event_type, ts FROM r WHERE n = 1 AND ts >= TIMESTAMP '2024-01-19 00:00:00'""")
def live_cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The latest entry of each key at a moment, if it is not older than a day."""
    moment = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    past = table(spark, folder, "events").where(F.col("ts").cast("timestamp_ntz") <= moment)
    last = past.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts").cast("timestamp_ntz") >= F.lit("2024-01-19 00:00:00").cast("timestamp_ntz"))

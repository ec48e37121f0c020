"""Queries of the knowledge graph and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.operators import graph, links
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table, written

R = Registry()
# Rules of relations as sentences of the tables state them; callers pass their own.
RULES = [
    ("leads", r"([A-Z][A-Za-z]+ [A-Z][A-Za-z]+), who leads the [A-Z][A-Za-z]+ office of ([A-Z][A-Za-z]+ [A-Z][A-Za-z]+)", 0.9),
    ("wrote to", r"wrote ([A-Z][A-Za-z]+ [A-Z][A-Za-z]+) in a letter to the owners of ([A-Z][A-Za-z]+ [A-Z][A-Za-z]+)", 0.8),
    ("closed plant of", r"workers of [A-Z][A-Za-z]+ [A-Z][A-Za-z]+ went home .* when ([A-Z][A-Za-z]+ [A-Z][A-Za-z]+) closed the (plant)", 0.7),
    ("told reporters in", r"([A-Z][A-Za-z]+ [A-Z][A-Za-z]+) told reporters in ([A-Z][A-Za-z]+)", 0.75),
]
KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '-+', '-', 'g'), '^[ -]+|[ -]+$', '', 'g'), '^(?:a|an|the) ', ''), '^[ -]+|[ -]+$', '', 'g')"
SENT = "SELECT id, unnest(regexp_split_to_array(coalesce(lede, ''), '[.!?]+')) AS s FROM raw_articles"
TRIPLES = f"WITH s AS ({SENT}), t AS (SELECT id, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {{'subject': {KEY.format(f'''regexp_extract(s, '{p}', 1)''')}, 'relation': '{r}', 'object': {KEY.format(f'''regexp_extract(s, '{p}', 2)''')}, 'confidence': {c}::DOUBLE}}" for r, p, c in RULES) + " END AS t FROM s), e AS (SELECT id, t.subject AS subject, t.relation AS relation, t.object AS object, t.confidence AS confidence FROM t WHERE t IS NOT NULL AND t.subject <> '' AND t.object <> '')\n"
ROLES = ", r AS (SELECT subject AS entity, 'subject' AS role, relation, object AS counterpart FROM e UNION ALL SELECT object, 'object', relation, subject FROM e)\n"


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "raw_articles").select("id", F.explode(F.split(tx.text_of(F.col("lede")), "[.!?]+")).alias("s"))
    return graph.pattern_triples(said, "s", RULES).drop("s")


@R.add(TRIPLES + "SELECT id, subject, relation, object, confidence FROM e")
def triples_extracted(spark: SparkSession, folder: str) -> DataFrame:
    return _triples(spark, folder)


@R.add(TRIPLES + "SELECT subject, relation, object, max(confidence) AS confidence, count(*) AS mentions FROM e GROUP BY ALL")
def triples_merged(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merged(_triples(spark, folder))


@R.add(TRIPLES + "SELECT relation, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM e GROUP BY relation")
def relation_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _triples(spark, folder).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


@R.add(TRIPLES + ROLES + "SELECT entity, role, relation, count(*) AS n FROM r GROUP BY ALL")
def entity_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.profiles(_triples(spark, folder))


@R.add(TRIPLES + ROLES + """, a AS (SELECT entity, count(*) FILTER (role = 'object') AS incoming, count(*) FILTER (role = 'subject') AS outgoing, count(DISTINCT relation) AS relations FROM r GROUP BY entity)
SELECT entity, incoming, outgoing, relations, round(ln(1 + incoming) / ln(1 + max(incoming) OVER ()), 6) AS authority FROM a""")
def entity_authority(spark: SparkSession, folder: str) -> DataFrame:
    return graph.authority(_triples(spark, folder)).withColumn("authority", F.round("authority", 6))


@R.add(TRIPLES + ROLES + """, f AS (SELECT entity, role, relation, counterpart, row_number() OVER (PARTITION BY entity ORDER BY relation, role, counterpart) AS rank FROM (SELECT DISTINCT * FROM r))
SELECT entity, list(relation || ':' || role || ':' || counterpart ORDER BY rank) AS facts FROM f WHERE rank <= 6 GROUP BY entity""")
def entity_dossiers(spark: SparkSession, folder: str) -> DataFrame:
    """Up to six facts of each entity, incoming and outgoing."""
    facts = graph.top_each(graph.roles(_triples(spark, folder)).distinct(), ["entity"], [F.col("relation"), F.col("role"), F.col("counterpart")], 6)
    return facts.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "relation", "role", "counterpart").alias("f")))), lambda x: x["f"]).alias("facts"))


@R.add(TRIPLES + """SELECT relation, CASE relation WHEN 'leads' THEN 'employment' WHEN 'wrote to' THEN 'communication' WHEN 'told reporters in' THEN 'location' ELSE 'other' END AS schema_relation,
max(CASE WHEN relation IN ('leads', 'wrote to', 'told reporters in') THEN 0.9 ELSE 0.5 END)::DOUBLE AS mapping, count(*) AS n FROM e GROUP BY 1, 2""")
def relation_schema_map(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.createDataFrame([("leads", "employment"), ("wrote to", "communication"), ("told reporters in", "location")], "relation string, schema_relation string")
    # Three literal rows.
    mapped = _triples(spark, folder).join(F.broadcast(known), "relation", "left").withColumn("mapping", F.when(F.col("schema_relation").isNull(), 0.5).otherwise(0.9)).withColumn("schema_relation", F.coalesce("schema_relation", F.lit("other")))
    return mapped.groupBy("relation", "schema_relation").agg(F.max("mapping").alias("mapping"), F.count("*").alias("n"))


@R.add("""WITH p AS (SELECT lower(trim(name)) AS a, lower(trim(unnest(aliases))) AS b FROM news_sources)
SELECT DISTINCT * FROM (SELECT a AS entity, b AS synonym FROM p UNION ALL SELECT b, a FROM p) WHERE entity <> synonym""")
def synonym_closure(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "news_sources").select(F.lower(F.trim("name")).alias("entity"), F.explode("aliases").alias("x")).select("entity", F.lower(F.trim("x")).alias("synonym"))
    return graph.symmetric(pairs, "entity", "synonym")


@R.add("""WITH c AS (SELECT symbol, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s-]+', '', 'g'), '\\s+', ' ', 'g')) AS k FROM companies)
SELECT symbol, round(1 - levenshtein(k, 'holdings') / greatest(length(k), 8)::DOUBLE, 6) AS lexical, contains(k, 'holdings') AS contained FROM c""")
def entity_lexical_scores(spark: SparkSession, folder: str) -> DataFrame:
    name = tx.name_key(F.col("name"))
    return table(spark, folder, "companies").select("symbol", F.round(1 - F.levenshtein(name, F.lit("holdings")) / F.greatest(F.length(name), F.lit(8)), 6).alias("lexical"), name.contains("holdings").alias("contained"))


@R.add()
def entity_search(spark: SparkSession, folder: str) -> DataFrame:
    """Companies by likeness to a misspelt name, with sound among the measures; DuckDB has no soundex."""
    scored = table(spark, folder, "companies").select("symbol", "name", F.round(graph.match_score("capitol labs", F.col("name")), 6).alias("score"))
    return scored.where("score >= 0.2").orderBy(F.desc("score"), "symbol").limit(12)


HOST = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^([^/?]*)', 1)), ':[0-9]+$', ''), '^www[0-9]*\\.', '')"
DOM = HOST.format("url")


@R.add("""
WITH u AS (SELECT id, trim(url) AS u, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS rest FROM raw_articles WHERE trim(coalesce(url, '')) <> ''),
q AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'mkt_tok', 'icid', 'ref', 'ref_', 'cmpid', 'clid'], lower(split_part(p, '=', 1)))) AS kept FROM u),
l AS (SELECT *, list_sort(list_transform(list_filter(kept, lambda p, i: NOT list_contains(list_transform(kept[i + 1:], lambda x: split_part(x, '=', 1)), split_part(p, '=', 1))), lambda p: {'k': split_part(p, '=', 1), 'p': p})) AS last FROM q)
SELECT id, CASE WHEN scheme = '' OR host = '' THEN u ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(last) > 0 THEN '?' || array_to_string(list_transform(last, lambda x: x.p), '&') ELSE '' END END AS url FROM l""")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_articles").select("id", urls.canonical(F.col("url")).alias("url")).where("url IS NOT NULL")


@R.add(f"SELECT {DOM} AS domain, count(*) AS pages, count(DISTINCT source) AS sources, max(received_at) AS last_seen FROM raw_articles WHERE trim(coalesce(url, '')) <> '' GROUP BY 1")
def domain_rollup(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "")
    return pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("source").alias("sources"), F.max("received_at").alias("last_seen"))


@R.add(f"""WITH d AS (SELECT DISTINCT {DOM} AS d FROM raw_articles WHERE trim(coalesce(url, '')) <> '')
SELECT d AS domain, round(coalesce(max(trust_score), 0.52), 6) AS trust FROM d LEFT JOIN news_sources s ON d.d = s.domain OR d.d LIKE '%.' || s.domain GROUP BY d""")
def domain_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Trust of each domain by itself or the longest known domain it ends in; 0.52 else."""
    seen = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(urls.domain(F.col("url")).alias("domain")).distinct()
    labels = F.split("domain", r"\.")
    # All suffixes of a domain are joined by equality, in place of a comparison with every known domain.
    ends = seen.select("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("end"))
    known = table(spark, folder, "news_sources").groupBy(F.col("domain").alias("end")).agg(F.max("trust_score").alias("t"))
    return ends.join(known, "end", "left").groupBy("domain").agg(F.round(F.coalesce(F.max("t"), F.lit(0.52)), 6).alias("trust"))


LINKS = f"WITH l AS (SELECT lower(trim(source)) AS src, {DOM} AS dst, received_at FROM raw_articles WHERE trim(coalesce(url, '')) <> '' AND trim(coalesce(source, '')) <> ''), g AS (SELECT src, dst, count(*) AS count, min(received_at) AS first_seen, max(received_at) AS last_seen FROM l GROUP BY src, dst)\n"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_articles").where((F.trim(tx.text_of(F.col("url"))) != "") & (F.trim(tx.text_of(F.col("source"))) != ""))
    return links.ledger(pages.select(F.lower(F.trim("source")).alias("s"), urls.domain(F.col("url")).alias("d"), "received_at"), "s", "d", "received_at")


@R.add(LINKS + "SELECT src, dst, count, first_seen, last_seen FROM g")
def link_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder)


@R.add(LINKS + """, t AS (SELECT lower(name) AS src, max(trust_score) AS t FROM news_sources GROUP BY 1)
SELECT dst, sum(count)::BIGINT AS inbound, count(DISTINCT src) AS sources, round(least(1.0, greatest(0.0, 0.52 + least(0.25, 0.05 * count(DISTINCT src)) + least(0.4, ln(1 + sum(coalesce(t, 0.52) * ln(1 + count))) / 3))), 6) AS authority FROM g LEFT JOIN t USING (src) GROUP BY dst""")
def page_authority(spark: SparkSession, folder: str) -> DataFrame:
    trust = table(spark, folder, "news_sources").groupBy(F.lower("name").alias("src")).agg(F.max("trust_score").alias("t"))
    # The table of sources is fixed by the data model.
    led = _ledger(spark, folder).join(F.broadcast(trust), "src", "left")
    return links.page_authority(led, F.coalesce("t", F.lit(links.BASELINE)), F.lit(links.BASELINE)).withColumn("authority", F.round("authority", 6))


@R.add(LINKS + "SELECT dst, arg_min(src, (-count, src)) AS parent FROM g GROUP BY dst")
def link_parent(spark: SparkSession, folder: str) -> DataFrame:
    return links.parents(_ledger(spark, folder))


@R.add("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(a)) AS s, lower(trim(b)) AS d FROM (SELECT id, unnest(entities) AS a FROM raw_articles) x JOIN (SELECT id, unnest(entities) AS b FROM raw_articles) y USING (id) WHERE lower(trim(a)) <> lower(trim(b)) AND trim(a) <> '' AND trim(b) <> ''),
b AS (SELECT min(s) AS node, 0 AS depth FROM e UNION SELECT d, depth + 1 FROM b JOIN e ON e.s = b.node WHERE depth < 3)
SELECT node, min(depth)::INT AS depth FROM b GROUP BY node""")
def bfs_reachable(spark: SparkSession, folder: str) -> DataFrame:
    """Entities at most three articles away from the first entity by name."""
    each = table(spark, folder, "raw_articles").select("id", F.explode("entities").alias("e")).select("id", F.lower(F.trim("e")).alias("e")).where("e <> ''").distinct()
    edges = written(each.join(each.select("id", F.col("e").alias("d")), "id").where("e <> d").select("e", "d").distinct(), "edges")
    return links.reachable(edges, "e", "d", edges.agg(F.min("e")), 3)


@R.add("""WITH g AS (SELECT user_id, date_diff('second', lag(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts), date_trunc('second', ts)) / 60.0 AS gap FROM events)
SELECT user_id, count(*) AS samples, round(greatest(5.0, median(gap)), 3) AS minutes FROM g WHERE gap IS NOT NULL GROUP BY user_id""")
def change_cadence_median(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return links.cadence(events, "user_id", "ts").withColumn("minutes", F.round("minutes", 3))


@R.add(f"""WITH p AS (SELECT {DOM} || regexp_extract(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^[^/?]*([^?]*)', 1) AS page, id, received_at, md5(coalesce(lede, '')) AS d, list_distinct(coalesce(entities, [])) AS i FROM raw_articles WHERE trim(coalesce(url, '')) <> ''),
v AS (SELECT *, lag(d) OVER w AS before, lag(i) OVER w AS prior FROM p WINDOW w AS (PARTITION BY page ORDER BY received_at, id)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> d THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY received_at, id) AS revision FROM v)
SELECT page, revision::BIGINT AS revision, id, list_sort(list_filter(i, lambda x: NOT list_contains(coalesce(prior, []), x))) AS added, list_sort(list_filter(coalesce(prior, []), lambda x: NOT list_contains(i, x))) AS removed FROM n WHERE (before IS NULL OR before <> d) AND revision > 1""")
def revision_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Later versions of a page, with the entities they gained and lost."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(F.concat(urls.domain(F.col("url")), urls.path(F.col("url"))).alias("page"), "id", "received_at", F.md5(tx.text_of(F.col("lede"))).alias("d"), "entities")
    return links.revisions(pages, "page", "received_at", "id", F.col("d"), F.col("entities")).where("revision > 1")


@R.add(f"""WITH p AS (SELECT id, {DOM} AS domain, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS rest FROM raw_articles WHERE trim(coalesce(url, '')) <> '')
SELECT id, domain, NOT list_has_any(list_transform(string_split(lower(regexp_extract(rest, '^[^/?]*([^?]*)', 1)), '/'), lambda x: trim(x)), string_split('about|account|advert|advertisement|advertising|careers|company|contact|cookies|copyright|faq|feedback|finance|help|home|investors|legal|login|logout|menu|newsletter|privacy|register|settings|signin|signout|signup|subscribe|support|terms', '|')) AND NOT regexp_matches(lower(regexp_extract(rest, '^[^?]*\\?(.*)$', 1)), 'about|account|advert|advertisement|advertising|careers|company|contact|cookies|copyright|faq|feedback|finance|help|home|investors|legal|login|logout|menu|newsletter|privacy|register|settings|signin|signout|signup|subscribe|support|terms') AS useful FROM p""")
def useful_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "")
    return pages.select("id", urls.domain(F.col("url")).alias("domain"), urls.useful(F.col("url")).alias("useful"))


@R.add(f"""WITH t AS (SELECT {HOST.format('url')} AS d, title, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY received_at DESC, id) AS rank FROM raw_articles WHERE trim(coalesce(url, '')) <> '')
SELECT d AS domain, rank, title FROM t WHERE rank <= 5""")
def newest_per_domain(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest titles of each domain."""
    pages = table(spark, folder, "raw_articles").where(F.trim(tx.text_of(F.col("url"))) != "").select(urls.domain(F.col("url")).alias("domain"), "title", "received_at", "id")
    return graph.top_each(pages, ["domain"], [F.desc("received_at"), F.col("id")], 5).select("domain", "rank", "title")

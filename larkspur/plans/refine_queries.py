"""Queries of text refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import refine
from larkspur.plans.registry import Registry
from larkspur.sources.tables import table

R = Registry()
W = r"[ \t\n\x0B\f\r]+"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _plain(text: str) -> str:
    """SQL of plain_words()."""
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_'']+'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: regexp_full_match(w, '[\p{{L}}'']+'))"


def _verb(word: str) -> str:
    return f"(list_contains({_list(refine.VERBS)}, {word}) OR regexp_matches({word}, '^[a-z]{{3,}}(?:ed|ing|en|es)$'))"


def _has_verb(words: str) -> str:
    return f"(len(list_filter({words}, lambda w: list_contains({_list(refine.AUXILIARIES)}, lower(w)) OR {_verb('lower(w)')})) > 0)"


def _tags(words: str, subject: str) -> str:
    v = _verb("lower(w)")
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN {subject} AND {v} THEN 'b' WHEN {subject} THEN 's' WHEN {v} THEN 'v' ELSE 'o' END), '')"


SUBJECT = f"(list_contains({_list(refine.PRONOUNS)}, lower(w)) OR (NOT list_contains({_list(refine.STOPWORDS + refine.NO_SUBJECTS)}, lower(w)) AND NOT {_verb('lower(w)')} AND (list_contains({_list(refine.LEXICON)}, lower(w)) OR regexp_matches(w, '^[A-Z]'))))"
CLAUSE = f"(list_contains({_list(refine.CLAUSE_PRONOUNS)}, lower(w)) OR regexp_matches(w, '^[A-Z]'))"
OUTER = refine.OUTER.replace("'", "''")
ENDS = refine.ENDS.replace("'", "''")


def _parts(text: str) -> str:
    """SQL of sentence_parts()."""
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({text}, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda s: trim(s, ' ')), lambda s: s <> '')"


# Sound sentences of a table p(doc_id, s), in steps, as k(doc_id, s, ok).
SOUND = f"""b AS (SELECT doc_id, s, regexp_replace(s, '{OUTER}', '', 'g') AS bare FROM p), w AS (SELECT *, {_plain('bare')} AS ws FROM b),
t AS (SELECT *, {_tags('ws', SUBJECT)} AS tags, {_tags('ws', CLAUSE)} AS clauses, {_has_verb('ws')} AS verb, len(list_filter(ws, lambda w: list_contains({_list(refine.JOINERS)}, lower(w)))) > 0 AS joined FROM w),
k AS (SELECT doc_id, s, regexp_matches(bare, '^\\p{{Lu}}') AND regexp_matches(bare, '{ENDS}') AND len(ws) >= 2 AND (regexp_matches(bare, '[^\\x00-\\x7F]') OR (verb AND NOT (regexp_matches(lower(bare), '^(?:{"|".join(refine.STARTERS)}) ') AND NOT contains(bare, ','))
  AND NOT (NOT regexp_matches(bare, '[,;]') AND NOT joined AND len(regexp_extract_all(clauses, '[sb][^vb]*[vb]')) >= 2) AND regexp_matches(tags, '^[so]*s[so]*[vb]'))) AS ok FROM t)"""


@R.add(f"WITH p AS (SELECT doc_id, unnest({_parts('text')}) AS s FROM documents), {SOUND} SELECT doc_id, count(*) AS parts, count(*) FILTER (ok) AS sound FROM k GROUP BY doc_id")
def sound_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """How many stretches of a document are whole sentences."""
    parts = table(spark, folder, "documents").select("doc_id", F.explode(refine.sentence_parts(F.col("text"))).alias("s"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.count_if(refine.sound(F.col("s"))).alias("sound"))


WORDS_OF = "regexp_extract_all({0}, '[A-Za-z][A-Za-z'']*')"
COUNTER = refine.COUNTER.replace("'", "''")


def _count(words: str, known: list[str]) -> str:
    return f"len(list_filter({words}, lambda w: list_contains({_list(known)}, lower(w))))"


PLAIN_AUX = [a for a in refine.AUXILIARIES if not a.startswith(("need", "seem"))]
LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, line, trim(regexp_replace(trim(line, ' '), '^[\\-*•·]+[ \\t]*', ''), ' ') AS x FROM l), m AS (SELECT *, {WORDS_OF.format('x')} AS ws FROM n),
c AS (SELECT *, len(ws) AS n, {_count('ws', refine.LEXICON)} > 0 AS known, len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) AS capitals, len(list_distinct(list_transform(ws, lambda w: lower(w)))) AS kinds, {_count('ws', refine.NAVIGATION)} AS navigation, {_count('ws', refine.CATEGORIES)} AS topics, {_count('ws', refine.STOPWORDS)} AS stops,
  len(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9_]+'), lambda w: list_contains({_list(PLAIN_AUX)}, w) OR regexp_matches(w, '^[a-z]{{3,}}(?:ing|ed)$'))) > 0 AS verb FROM m),
d AS (SELECT *, CASE WHEN x = '' OR regexp_matches(lower(x), '{COUNTER}') OR n = 0 OR regexp_matches(lower(x), 'https?://') THEN true WHEN known THEN false
  WHEN (kinds = 1 AND n <= 4) OR (navigation >= 2 AND navigation >= n / 2) OR (topics >= 2 AND topics / n >= 0.6) THEN true WHEN n = capitals THEN false
  ELSE NOT (n >= 3 AND verb AND (stops >= 2 OR (stops >= 1 AND (capitals >= 1 OR regexp_matches(x, '[0-9]'))))) END AS meaningless,
  lower(trim(line, ' ')) AS low, list_filter(regexp_split_to_array(lower(trim(line, ' ')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS lw FROM c),
e AS (SELECT *, len(list_filter(lw, lambda w: list_contains({_list(refine.NAVIGATION)}, w))) AS hits FROM d)"""


@R.add(f"WITH {LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (meaningless) AS meaningless, count(*) FILTER (low = '' OR (NOT regexp_matches(low, '[0-9.!?]') AND hits >= 2 AND (hits >= len(lw) / 2 OR len(lw) <= 5))) AS navigation FROM e GROUP BY doc_id")
def refined_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of a document say nothing, and how many are made of navigation words."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(refine.meaningless(F.col("line"))).alias("meaningless"), F.count_if(refine.navigation_cluster(F.col("line"))).alias("navigation"))


KNOWN = f"(list_contains({_list(refine.LEXICON)}, lower(w)) OR regexp_matches(lower(w), '^[a-z]{{3,}}$'))"
MEANING = f"""p AS (SELECT doc_id, regexp_replace(s, '^[-•·]+[ \\t]+', '') AS s FROM (SELECT doc_id, unnest({_parts('text')}) AS s FROM documents)), {SOUND}, y AS (SELECT doc_id, bool_or(ok) AS ok FROM k GROUP BY doc_id),
u AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\n\\r]+'), lambda z: trim(z, ' ')), lambda z: regexp_matches(z, '^[-•·]+[ \\t]+'))) AS z FROM documents),
v AS (SELECT doc_id, bool_or(len(list_filter({_plain('z')}, lambda w: {KNOWN})) > 0 AND {_has_verb(_plain('z'))}) AS told FROM u GROUP BY doc_id),
g AS (SELECT doc_id, ws, len(ws) AS n, len(list_filter(ws, lambda w: {KNOWN})) AS hits, {_count('ws', refine.STOPWORDS)} AS stops FROM (SELECT doc_id, {_plain("coalesce(text, '')")} AS ws FROM documents)),
q AS (SELECT doc_id, coalesce(ok, false) OR coalesce(told, false) OR (n >= 5 AND hits > 0 AND {_has_verb('ws')} AND hits / greatest(n, 1) >= 0.45 AND (stops > 0 OR hits / greatest(n, 1) >= 0.65)) AS meaningful FROM g LEFT JOIN y USING (doc_id) LEFT JOIN v USING (doc_id))"""


@R.add(f"WITH {MEANING} SELECT doc_id, meaningful FROM q")
def meaningful_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", refine.meaningful(F.col("text")).alias("meaningful"))


@R.add(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), ' ') AS x FROM documents),
s AS (SELECT doc_id, list_concat(string_split(regexp_replace(x, '([.!?])[ \t\n\x0B\f]+([\p{{L}}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), regexp_split_to_array(x, '\n+')) AS s FROM t),
f AS (SELECT doc_id, list_distinct(list_transform(list_transform(list_filter(list_transform(s, lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')), lambda x: length(x) >= 12), lambda x: trim(regexp_replace(x, '^- ', ''), ' ')), lambda x: CASE WHEN length(x) > 220 THEN trim(substr(x, 1, 220), ' ') || '…' ELSE x END)) AS c FROM s)
SELECT doc_id, len(c) AS candidates, md5(array_to_string(list_sort(c), chr(10))) AS digest FROM f""")
def highlight_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches that highlights are chosen from, counted and by a digest."""
    found = table(spark, folder, "documents").select("doc_id", F.array_sort(refine.highlight_candidates(F.col("text"))).alias("c"))
    return found.select("doc_id", F.size("c").cast("bigint").alias("candidates"), F.md5(F.array_join("c", "\n")).alias("digest"))


@R.add(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before, CASE WHEN i < len(w) THEN w[i + 1] END AS behind, count(*) AS n FROM i WHERE w[i] IN ('regulator', 'merger') GROUP BY ALL""")
def token_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The words before and behind two words of interest, counted."""
    words = table(spark, folder, "documents").select(tx.words(F.col("text")).alias("w"))
    each = words.select(F.explode(F.filter(refine.neighbours(F.col("w")), lambda x: x["word"].isin("regulator", "merger"))).alias("x")).select("x.word", "x.before", "x.behind")
    return each.groupBy("word", "before", "behind").agg(F.count("*").alias("n"))


@R.add(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT doc_id, i - 1 AS place, array_to_string(w[greatest(1, i - 3):i + 4], ' ') AS context FROM i WHERE w[i] = 'merger'""")
def entity_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Three words before and four behind every mention of a word."""
    words = table(spark, folder, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    each = words.select("doc_id", "w", F.posexplode("w").alias("place", "x")).where("x = 'merger'")
    return each.select("doc_id", F.col("place").cast("bigint").alias("place"), F.array_join(refine.context(F.col("w"), F.col("place")), " ").alias("context"))


@R.add(f"""WITH {MEANING}, s AS (SELECT doc_id, count(*) AS parts, count(*) FILTER (ok) AS sound FROM k GROUP BY doc_id), a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len({_plain('t')}) AS words, coalesce(parts, 0) AS parts, coalesce(sound, 0) AS sound, meaningful, len(list_distinct(list_transform({_plain('t')}, lambda w: lower(w)))) AS kinds, len(regexp_extract_all(t, '\\?')) AS questions, len(string_split(t, chr(10))) AS lines FROM a JOIN q USING (doc_id) LEFT JOIN s USING (doc_id)""")
def analysis_records(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis of a document as one record, from one pass over its text."""
    text = tx.text_of(F.col("text"))
    words, parts = refine.plain_words(text), refine.sentence_parts(text)
    made = table(spark, folder, "documents").select("doc_id", text.alias("t"), words.alias("w"), F.transform(parts, lambda s: F.regexp_replace(s, r"^[-•·]+[ \t]+", "")).alias("p"), refine.meaningful(F.col("text")).alias("meaningful"))
    return made.select(
        "doc_id", F.size("w").cast("bigint").alias("words"), F.size("p").cast("bigint").alias("parts"), F.size(F.filter("p", lambda s: refine.sound(s))).cast("bigint").alias("sound"), "meaningful",
        F.size(F.array_distinct(F.transform("w", F.lower))).cast("bigint").alias("kinds"), F.regexp_count("t", F.lit(r"\?")).cast("bigint").alias("questions"), F.size(F.split("t", "\n")).cast("bigint").alias("lines"),
    )

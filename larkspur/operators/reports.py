"""Research reports: summaries, relevance, quality and freshness of sources, descriptions of facts, formats of keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx

# Words that are no keywords.
DISCARDED = "home menu privacy terms subscribe account contact login signup copyright navigation newsletter cookie".split()
#: Average of a signal that no document gives.
NEUTRAL = 0.5


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def first_sentence(text: Column, limit: int = 240) -> Column:
    """The trimmed text; if it is longer than the limit, its first sentence within it, and an ellipsis."""
    plain = F.regexp_replace(tx.text_of(text), "^" + tx.SPACE + "|" + tx.SPACE + r"\z", "")
    cut = F.substring(plain, 1, limit)
    one = F.regexp_replace(F.get(F.split(F.regexp_replace(cut, r"([.!?])[ \t\n\x0B\f\r]+", "$1\u0001"), "\u0001"), 0), tx.SPACE + r"\z", "")
    return F.when(F.length(plain) > limit, F.concat(one, F.lit("…"))).otherwise(plain)


def truncated(text: Column, limit: int = 200) -> Column:
    """The trimmed text; if it is longer than the limit, its whole words within it without closing marks, and an ellipsis."""
    plain = F.regexp_replace(tx.text_of(text), "^" + tx.SPACE + "|" + tx.SPACE + r"\z", "")
    cut = F.substring(plain, 1, limit)
    whole = F.regexp_replace(cut, r"[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*\z", "")
    return F.when(F.length(plain) > limit, F.concat(F.regexp_replace(F.when(whole == "", cut).otherwise(whole), r"[ \t\n\x0B\r.,;:]+\z", ""), F.lit("…"))).otherwise(plain)


def case_like(suggestion: Column, word: Column) -> Column:
    """A suggestion in the case of the word it replaces: capitals throughout, a capital first, or as it is."""
    letters = word.rlike(r"\p{L}")
    return F.when(letters & (F.upper(word) == word), F.upper(suggestion)).when(letters & F.substring(word, 1, 1).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(suggestion, 1, 1)), suggestion.substr(F.lit(2), F.length(suggestion)))).otherwise(suggestion)


def asked_words(query: Column) -> Column:
    """Distinct lower-cased words of a query of at least two characters, between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(tx.text_of(query)), tx.SPACE), lambda w: F.length(w) >= 2))


def source_quality(status: Column, characters: Column, paragraphs: Column, preview: Column, title: Column) -> Column:
    """55, + 8 if active, + 10, 6 or 3 from 3200, 1800 or 900 characters, + 6 or 3 from 12 or 6 paragraphs, + 4 each for a preview and a title; within 35 and 90. A null status is active."""
    n, p = F.coalesce(characters, F.lit(0)), F.coalesce(paragraphs, F.lit(0))
    score = F.lit(55.0) + F.when(F.lower(F.coalesce(status, F.lit("active"))) == "active", 8.0).otherwise(0.0)
    score = score + F.when(n >= 3200, 10.0).when(n >= 1800, 6.0).when(n >= 900, 3.0).otherwise(0.0) + F.when(p >= 12, 6.0).when(p >= 6, 3.0).otherwise(0.0)
    for text in (preview, title):
        score = score + F.when(F.trim(tx.text_of(text)) != "", 4.0).otherwise(0.0)
    return F.least(F.lit(90.0), F.greatest(F.lit(35.0), score))


def freshness(latest_year: Column, as_of_year: int) -> Column:
    """1 - years / 8 since the latest year, within 0 and 1; 0.5 without a year."""
    return F.when(latest_year.isNull(), NEUTRAL).otherwise(clamp(1 - F.least(F.lit(1.0), F.greatest(F.lit(0), F.lit(as_of_year) - latest_year) / 8)))


def signal_averages(documents: DataFrame, signals: list[str]) -> DataFrame:
    """One row: the mean of each signal over all documents, null counting as 0, within 0 and 1; 0.5 without documents."""
    return documents.agg(*[F.when(F.count("*") > 0, clamp(F.sum(F.coalesce(F.col(s), F.lit(0.0))) / F.count("*"))).otherwise(NEUTRAL).alias(s) for s in signals])


def relevance(asked: Column, keywords: Column, certainty: Column, uniqueness: Column, answers: Column) -> Column:
    """.5 of the query's words and .2 of the keywords that match, .2 certainty and .1 uniqueness; if that is 0, a score without the query.

    Without a query all keywords match and the first part is .5.
    """
    hits = F.when(F.size(asked) == 0, F.size(keywords)).otherwise(F.size(F.array_intersect(asked, keywords)))
    covered = F.when(F.size(asked) == 0, 0.5).otherwise(clamp(hits / F.size(asked)))
    share = F.when(F.size(keywords) > 0, clamp(hits / F.size(keywords))).otherwise(0.0)
    score = clamp(0.5 * covered + 0.2 * share + 0.2 * certainty + 0.1 * uniqueness)
    otherwise = clamp(0.45 * certainty + 0.35 * uniqueness + F.when(F.size(keywords) > 0, 0.1).otherwise(0.0) + F.when(answers > 0, 0.1).otherwise(0.0))
    return F.when(score > 0, score).otherwise(otherwise)


def described(role: Column, relation: Column, counterpart: Column) -> Column:
    """A sentence of a fact, seen from the entity; role object for incoming ones. Null without relation and counterpart."""
    r, c = F.trim(tx.text_of(relation)), F.trim(tx.text_of(counterpart))
    linked = F.concat(F.lit("Connected to "), c, F.lit("."))
    incoming = F.when((c != "") & (r != ""), F.concat(F.lit("Receives “"), r, F.lit("” from "), c, F.lit("."))).when(c != "", linked).otherwise(F.concat(F.lit("Receives relation “"), r, F.lit("”.")))
    outgoing = F.when((c != "") & (r != ""), F.concat(F.lit("Links to "), c, F.lit(" via “"), r, F.lit("”."))).when(r != "", F.concat(F.lit("Links via “"), r, F.lit("”."))).otherwise(linked)
    return F.when((r != "") | (c != ""), F.when(role == "object", incoming).otherwise(outgoing))


def summaries(roles: DataFrame, facts: int = 6) -> DataFrame:
    """Columns entity, fact_count, facts: distinct descriptions in order, at most so many; the feature is a short list, the count is whole."""
    each = roles.distinct().select("entity", described(F.col("role"), F.col("relation"), F.col("counterpart")).alias("d")).where("d IS NOT NULL").distinct()
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("d"))).where(F.col("_n") <= facts)
    listed = first.groupBy("entity").agg(F.sort_array(F.collect_list("d")).alias("facts"))
    return each.groupBy("entity").agg(F.count("*").alias("fact_count")).join(listed, "entity").select("entity", "fact_count", "facts")


def keywords(counts: DataFrame, key: str, token: str, count: str, limit: int = 10) -> DataFrame:
    """The key's keywords with their rank: not discarded, of three characters and more, the highest count of each, the most frequent first, of equals the first by name."""
    kept = counts.select(key, F.trim(token).alias("token"), F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias("count")).where((F.length("token") > 2) & ~F.lower("token").isin(DISCARDED))
    best = kept.groupBy(key, F.lower("token").alias("_t")).agg(F.max("count").alias("count"), F.min("token").alias("token"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "_t"))).where(F.col("rank") <= limit).select(key, "rank", "token", "count")


def volatility_label(volatility: Column) -> Column:
    return F.when(volatility >= 60, "extremely elevated").when(volatility >= 40, "elevated").when(volatility >= 25, "moderate").otherwise("calm")

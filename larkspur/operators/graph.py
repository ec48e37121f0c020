"""Triples, their statistics, entity resolution and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions.similarity import metaphone, similar_text


def pattern_triples(sentences: DataFrame, sentence: str, patterns: list[tuple[str, str, float]]) -> DataFrame:
    """Columns subject, relation, object, confidence of each sentence a pattern matches; the first pattern wins.

    patterns: (relation, regular expression with two groups, confidence). The
    rules are data: they become one expression, evaluated once a sentence.
    """
    text = F.col(sentence)
    found = None
    for relation, regex, confidence in patterns:
        hit = F.struct(tx.entity_key(F.regexp_extract(text, regex, 1)).alias("subject"), F.lit(relation).alias("relation"), tx.entity_key(F.regexp_extract(text, regex, 2)).alias("object"), F.lit(confidence).alias("confidence"))
        found = F.when(text.rlike(regex), hit) if found is None else found.when(text.rlike(regex), hit)
    # The generator keeps the expression in one place: it is evaluated once a sentence, whatever reads its fields.
    return sentences.withColumn("_t", F.explode(F.array_compact(F.array(found)))).where("_t.subject <> '' AND _t.object <> ''").select("*", "_t.*").drop("_t")


def merged(triples: DataFrame) -> DataFrame:
    """The set of triples with the highest confidence and the number of times each was said."""
    return triples.groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))


def roles(triples: DataFrame) -> DataFrame:
    """Columns entity, role, relation, counterpart: each triple from both ends."""
    subject = triples.select(F.col("subject").alias("entity"), F.lit("subject").alias("role"), "relation", F.col("object").alias("counterpart"))
    return subject.unionAll(triples.select(F.col("object").alias("entity"), F.lit("object").alias("role"), "relation", F.col("subject").alias("counterpart")))


def profiles(triples: DataFrame) -> DataFrame:
    """Columns entity, role, relation, n; repeats count."""
    return roles(triples).groupBy("entity", "role", "relation").agg(F.count("*").alias("n"))


def authority(triples: DataFrame) -> DataFrame:
    """Columns entity, incoming, outgoing, relations, authority = ln(1 + incoming) / ln(1 + most incoming); 0.35 if nothing has any."""
    each = roles(triples).groupBy("entity").agg(F.count_if(F.col("role") == "object").alias("incoming"), F.count_if(F.col("role") == "subject").alias("outgoing"), F.count_distinct("relation").alias("relations"))
    most = each.agg(F.max("incoming").alias("_m"))
    return each.crossJoin(F.broadcast(most)).select("entity", "incoming", "outgoing", "relations", F.when(F.col("_m") > 0, F.log1p("incoming") / F.log1p("_m")).otherwise(0.35).alias("authority"))


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each pair, once, without loops."""
    return pairs.select(a, b).union(pairs.select(F.col(b).alias(a), F.col(a).alias(b))).where(F.col(a) != F.col(b)).distinct()


def token_similarity(a: Column, b: Column) -> Column:
    """Shared over united tokens of two arrays; 0 if both are empty."""
    united = F.size(F.array_union(a, b))
    return F.when(united > 0, F.size(F.array_intersect(a, b)) / united).otherwise(0.0)


def match_score(needle: str, candidate: Column) -> Column:
    """.45 likeness of the strings + .25 token similarity + .2 sound + .1 affinity (prefix 1, contained .6) to a needle, 1 for equality.

    Likeness is the better of shared text and edit similarity; sound is 1 for
    one metaphone key and .7 for one soundex.
    """
    name = tx.name_key(candidate)
    key = F.lit(needle)
    longest = F.greatest(F.length(name), F.lit(len(needle)))
    edits = F.when(longest > 0, 1 - F.levenshtein(name, key) / longest).otherwise(0.0)
    lexical = F.greatest(edits, similar_text(key, name) / 100)
    tokens = token_similarity(tx.name_tokens(candidate), F.array(*[F.lit(t) for t in dict.fromkeys(needle.replace("-", " ").split())]))
    sounds = metaphone(name)
    sound = F.when((sounds != "") & (sounds == metaphone(key)), 1.0).when((F.soundex(name) != "") & (F.soundex(name) == F.soundex(key)), 0.7).otherwise(0.0)
    affinity = F.when(name.startswith(needle), 1.0).when(name.contains(needle), 0.6).otherwise(0.0)
    return F.when(name == key, 1.0).otherwise(0.45 * lexical + 0.25 * tokens + 0.2 * sound + 0.1 * affinity)


def top_each(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)

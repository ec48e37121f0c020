"""Analyses of texts that take more than one expression: phrases, spelling, acronyms, sections, related documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larkspur.functions import text as tx
from larkspur.functions.similarity import similar_text


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The name of the first rule of which a phrase is in the lower-cased text."""
    low = F.lower(tx.text_of(text))
    out = F.when(F.lit(False), F.lit(default))
    for name, phrases in rules:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), name)
    return out.otherwise(F.lit(default))


def all_matches(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The names of all rules of which a phrase is in the lower-cased text, in the order of the rules."""
    low = F.lower(tx.text_of(text))
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), F.lit(name)) for name, phrases in rules]))


def key_phrases(df: DataFrame, key: str, text: str, boundaries: list[str], limit: int = 12) -> DataFrame:
    """Columns key, rank, phrase, score: runs of words between boundary words, sentences and lines.

    A run of at least four characters scores (1 + min(.9, .35 (n - 1))) (1 + min(.6, .2 (distinct - 1))) + .05 for each word of
    seven letters or more, summed over its uses and divided by the document's best. Words of up to two characters and the
    boundary words end a run. Ties go to the phrase first in order.
    """
    stop = F.array(*[F.lit(b) for b in boundaries])
    marked = F.transform(tx.words(F.col("_s")), lambda w: F.when((F.length(w) <= 2) | F.array_contains(stop, w), F.lit("\n")).otherwise(w))
    said = df.select(key, F.explode(F.split(tx.text_of(F.col(text)), r"[.!?]+\s+|[.!?]+$|\n+")).alias("_s")).select(key, F.explode(F.split(F.array_join(marked, " "), r"\s*\n\s*")).alias("_p"))
    runs = said.select(key, F.trim("_p").alias("phrase")).where(F.length("phrase") >= 4).withColumn("_w", F.split("phrase", " "))
    n, kinds = F.size("_w"), F.size(F.array_distinct("_w"))
    one = (1 + F.least(F.lit(0.9), (n - 1) * 0.35)) * (1 + F.least(F.lit(0.6), (kinds - 1) * 0.2)) + 0.05 * F.size(F.filter("_w", lambda w: F.length(w) >= 7))
    scored = runs.groupBy(key, "phrase").agg(F.sum(one).alias("_score"))
    best = Window.partitionBy(key)
    ranked = scored.withColumn("score", F.round(F.least(F.lit(1.0), F.col("_score") / F.max("_score").over(best)), 6)).withColumn("rank", F.row_number().over(best.orderBy(F.desc(F.round("_score", 9)), "phrase")))
    return ranked.where(F.col("rank") <= limit).select(key, "rank", "phrase", "score")


def remainders(df: DataFrame, column: str, name: str) -> DataFrame:
    """Columns name (the word) and _k: what is left of each word after at most two deletions. Words within two edits have one in common."""

    def shorter(step: DataFrame) -> DataFrame:
        k = F.col("_k")
        cut = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(F.col("_k"), 1, i - 1), F.substring(F.col("_k"), i + 1, F.length(F.col("_k")))))
        return step.where(F.length("_k") > 0).select(name, F.explode(cut).alias("_k")).distinct()

    whole = df.select(F.col(column).alias(name), F.col(column).alias("_k"))
    one = shorter(whole)
    return whole.unionAll(one).unionAll(shorter(one)).distinct()


def spelling(words: DataFrame, word: str, lexicon: DataFrame, known: str, limit: int = 3) -> DataFrame:
    """Columns word, rank, suggestion, distance: known words at most two edits from each word that is not known.

    Two words within two edits have a common remainder after at most two
    deletions each, so both sides' remainders are joined by equality; no word
    is compared with the whole lexicon. Order: distance + .1 if the first
    letters differ + .05 if the first two do + .01 for each letter of
    difference in length, then the suggestion.
    """
    unknown = words.select(F.col(word).alias("word")).where(F.length("word") > 2).distinct().join(lexicon.select(F.col(known).alias("word")), "word", "left_anti")
    near = remainders(unknown, "word", "word").join(remainders(lexicon.select(known).where(F.length(known) > 2).distinct(), known, "suggestion"), "_k").select("word", "suggestion").distinct()
    scored = near.withColumn("distance", F.levenshtein("word", "suggestion", 2)).where("distance BETWEEN 1 AND 2")
    score = F.col("distance") + F.when(F.substring("word", 1, 1) != F.substring("suggestion", 1, 1), 0.1).otherwise(0.0) + F.when(F.substring("word", 1, 2) != F.substring("suggestion", 1, 2), 0.05).otherwise(0.0) + 0.01 * F.abs(F.length("word") - F.length("suggestion"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.round(score, 6), "suggestion")))
    return ranked.where(F.col("rank") <= limit).select("word", "rank", "suggestion", "distance")


# Pattern with its two groups, which of them is the acronym, confidence, and that where its letters begin the words.
ACRONYMS = [
    (r"\b([A-Za-z][A-Za-z&\-.]+(?:\s+[A-Za-z][A-Za-z&\-.]+){0,6})\s*\(([A-Z][A-Z0-9&]{2,})\)", 2, 0.82, 0.95),
    (r"\b([A-Z][A-Z0-9&]{2,})\s*\(([^)]+)\)", 1, 0.78, 0.9),
    (r"(?i)\b([A-Z]{2,})\b\s+(?:stands for|is short for|means|abbreviates)\s+([^.;:\n\r]{3,80})", 1, 0.8, 0.92),
]


def acronyms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, acronym, expansion, confidence: the surest expansion of each acronym; of equals the first in order."""
    found = []
    for pattern, which, low, high in ACRONYMS:
        short, long = (F.regexp_extract("_m", pattern, g) for g in (which, 3 - which))
        hits = df.select(key, F.explode(F.regexp_extract_all(tx.text_of(F.col(text)), F.lit(pattern), 0)).alias("_m")).select(
            key, F.upper(F.regexp_replace(short, "[^A-Za-z0-9]", "")).alias("acronym"), tx.squeezed(F.regexp_replace(long, r"^[\s\"'\[\](){}]+|[\s\"'\[\](){}]+$", "")).alias("expansion"))
        initials = F.upper(F.array_join(F.transform(F.filter(F.split("expansion", r"[\s\-&]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))
        found.append(hits.where("acronym <> '' AND expansion <> ''").withColumn("confidence", F.when(initials == F.col("acronym"), high).otherwise(low)))
    every = reduce(DataFrame.unionAll, found)
    best = every.groupBy(key, "acronym").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("expansion").alias("e"))).alias("_b"))
    return best.select(key, "acronym", F.col("_b.e").alias("expansion"), (-F.col("_b.c")).alias("confidence"))


_SECTION = T.StructType([T.StructField("_key", T.LongType()), T.StructField("section", T.IntegerType()), T.StructField("paragraphs", T.IntegerType()), T.StructField("text", T.StringType())])


def sections(df: DataFrame, key: str, text: str, overlap: float = 0.3) -> DataFrame:
    """Columns key, section (from 0), paragraphs, text: paragraphs joined to the section before them while they share enough words.

    Paragraphs stand between blank lines. A paragraph goes on with its section
    if the words of four letters or more that both have are at least the
    overlap's share of the smaller set.
    """

    def words(p: str) -> set[str]:
        return {w for w in "".join(c if c.isalnum() else " " for c in p.lower()).split() if len(w) > 3}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["_key"].tolist(), batch["_text"].tolist()):
                section: list[str] = []
                held: set[str] = set()
                done = 0
                for p in (x.strip() for x in (t or "").replace("\r\n", "\n").split("\n\n")):
                    if not p:
                        continue
                    own = words(p)
                    small = min(len(own), len(held))
                    if section and not (small and len(own & held) / small >= overlap):
                        out.append((k, done, len(section), "\n\n".join(section)))
                        section, held, done = [], set(), done + 1
                    section.append(p)
                    held |= own
                if section:
                    out.append((k, done, len(section), "\n\n".join(section)))
            yield pd.DataFrame(out, columns=_SECTION.names)

    return df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).mapInPandas(work, _SECTION).withColumnRenamed("_key", key)


def related_documents(weights: DataFrame, key: str, term: str, weight: str, queries: Column, least: float, limit: int) -> DataFrame:
    """Columns query, rank, key, score: the documents with the highest cosine to each query document, by sparse term weights.

    queries is a condition that names the query documents; all others are searched.
    """
    norms = weights.groupBy(F.col(key).alias("_d")).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_n"))
    unit = weights.join(norms, F.col(key) == F.col("_d")).where("_n > 0").select(F.col(key).alias("_k"), F.xxhash64(F.col(term)).alias("_t"), (F.col(weight) / F.col("_n")).alias("_w"))
    asked = weights.select(key).where(queries).distinct().select(F.col(key).alias("_k"))
    q = unit.join(asked, "_k", "left_semi").select(F.col("_k").alias("query"), "_t", F.col("_w").alias("_v"))
    scored = unit.join(q, "_t").where("_k <> query").groupBy("query", "_k").agg(F.sum(F.col("_w") * F.col("_v")).alias("score")).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "_k")))
    return ranked.where(F.col("rank") <= limit).select("query", "rank", F.col("_k").alias(key), "score")


def near_duplicate(a: Column, b: Column, limit: int | None = None) -> Column:
    """Whether two texts are near-duplicates: equal, one in the other (from 24 characters, then by their lengths' ratio of .65 alone), 92 % similar, or .82 of the smaller set of longer words shared.

    Whole texts are compared unless a limit of characters is given. Texts
    whose lengths rule a likeness of 92 % out are not measured for it.
    """
    x, y = (F.lower(tx.squeezed(t)) if limit is None else F.substring(F.lower(tx.squeezed(t)), 1, limit) for t in (a, b))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    alike = 200 * short >= 92 * (short + long)

    def tokens(t: Column) -> Column:
        return F.array_distinct(F.filter(tx.ascii_words(t), lambda w: F.length(w) >= 4))

    tx_, ty = tokens(x), tokens(y)
    smaller = F.least(F.size(tx_), F.size(ty))
    overlap = F.when(smaller > 0, F.size(F.array_intersect(tx_, ty)) / smaller).otherwise(0.0)
    inside = (short >= 24) & (x.contains(y) | y.contains(x))
    return F.when((x == "") | (y == ""), False).when(x == y, True).when(inside, short / long >= 0.65).otherwise((overlap >= 0.82) | (similar_text(F.when(alike, x), F.when(alike, y)) >= 92))

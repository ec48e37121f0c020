"""Search of news: the profile of a query, the signals of a match, and the weight by which results are ordered."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.variants import term_variants
from larkspur.operators.ranking import bm25_scores

# Points of the signals.
BM25, PHRASE, BIGRAM, BIGRAM_WEIGHT, TOPIC, ENTITY, ENTITY_NEAR, TERM_NEAR, SEMANTIC, SEMANTIC_PHRASE, PHRASE_HOLDS = 14.0, 6.0, 4.4, 0.72, 3.4, 2.8, 1.5, 1.2, 4.6, 5.2, 1.4
# Weights of synonyms as phrases and of their words.
SYNONYM, SYNONYM_WORD = 0.85, 0.7
# Hours and their points, and points of the kinds of page.
RECENCY = [(4, 12.0), (12, 8.0), (24, 5.0), (72, 3.0), (168, 1.5)]
KINDS = {"article": 12.0, "page": 4.0, "non_article": -8.0, "error": -12.0}


@dataclass
class Profile:
    """What a query asks for: its own terms, all terms with weights, phrases with weights, and neighbouring terms."""

    terms: list[str]
    weights: dict[str, float] = field(default_factory=dict)
    phrases: dict[str, float] = field(default_factory=dict)
    bigrams: list[str] = field(default_factory=list)


def profile(query: str, synonyms: dict[str, list[str]] | None = None) -> Profile:
    """The profile of a query: terms with weight 1, their variants, synonyms of terms as phrases and by word; quoted phrases; the greater weight counts."""
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+(?:-[^\W_]+)*", query.lower())))
    out = Profile(terms, phrases={p.strip().lower(): 1.0 for p in re.findall(r'"([^"\n]+)"', query) if p.strip()}, bigrams=[f"{a} {b}" for a, b in zip(terms, terms[1:])])

    def put(where: dict[str, float], what: str, weight: float) -> None:
        where[what] = max(where.get(what, 0.0), weight)

    for term in terms:
        for variant, weight in term_variants(term).items():
            put(out.phrases if " " in variant else out.weights, variant, weight)
        for other in (synonyms or {}).get(term, []):
            other = other.strip().lower()
            put(out.phrases if " " in other else out.weights, other, SYNONYM)
            for word in other.split() if " " in other else []:
                put(out.weights, word, SYNONYM_WORD)
    return out


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _near(token: Column, terms: list[str]) -> Column:
    """Whether a token is one or two edits from a term of four letters and more."""
    return reduce(lambda a, b: a | b, [F.levenshtein(token, F.lit(t), 2).isin(1, 2) for t in terms if len(t) >= 4], F.lit(False))


def match_signals(words: Column, low: Column, topics: Column, entities: Column, asked: Profile, semantics: dict[str, float] | None = None, own: Column | None = None) -> dict[str, Column]:
    """The points of every signal but BM25, by name.

    words: the text's words; low: the lower-cased text; topics, entities:
    arrays of names; semantics: weights of the query's semantic terms; own: a
    map of the entry's semantic terms and weights.
    """
    known, none = list(asked.weights), F.array().cast("array<string>")
    pairs = tx.bigrams(words)
    named = F.transform(F.coalesce(entities, none), lambda e: tx.words(e))
    hits = F.transform(named, lambda e: F.when(F.arrays_overlap(e, _list(known)), ENTITY).when(F.exists(e, lambda t: _near(t, asked.terms)), ENTITY_NEAR).otherwise(0.0))
    out = {
        "phrases": reduce(lambda a, b: a + b, [F.when(low.contains(p), PHRASE * w).otherwise(0.0) for p, w in asked.phrases.items()], F.lit(0.0)),
        "bigrams": reduce(lambda a, b: a + b, [F.when(F.array_contains(pairs, b), BIGRAM * BIGRAM_WEIGHT).otherwise(0.0) for b in asked.bigrams], F.lit(0.0)),
        "topics": TOPIC * F.size(F.filter(F.coalesce(topics, none), lambda t: F.arrays_overlap(tx.words(t), _list(known)))),
        "entities": F.aggregate(hits, F.lit(0.0), lambda a, x: a + x),
        "near": reduce(lambda a, b: a + b, [F.when(F.exists(words, lambda w: ~w.isin(known) & _near(w, [t])), TERM_NEAR).otherwise(0.0) for t in asked.terms if len(t) >= 4], F.lit(0.0)),
    }
    if semantics and own is not None:
        out["semantic"] = reduce(lambda a, b: a + b, [F.when(own[t].isNotNull(), SEMANTIC * (own[t] + w) / 2).otherwise(0.0) for t, w in semantics.items()])
    return out


def recency(moment: Column, as_of: str) -> Column:
    """12, 8, 5, 3 or 1.5 points within 4, 12, 24, 72 or 168 hours; moments to come count as now, null gives none."""
    hours = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.date_trunc("second", moment.cast("timestamp")), F.lit(as_of).cast("timestamp"))) / 3600
    out = F.lit(0.0)
    for limit, points in reversed(RECENCY):
        out = F.when(hours <= limit, points).otherwise(out)
    return F.when(moment.isNull(), 0.0).otherwise(out)


def kind_points(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, points in KINDS.items():
        out = F.when(kind == name, points).otherwise(out)
    return out


def search(docs: DataFrame, key: str, asked: Profile, as_of: str, limit: int = 24, filters: dict[str, str] | None = None, semantics: dict[str, float] | None = None) -> DataFrame:
    """The best results of a query: key, match, weight.

    docs: key, text, topics, entities (arrays), quality (0 to 100), fetched_at,
    content_type, ingest (boolean), domain, and own (a map of semantic terms)
    if semantics are given. The match is 14 BM25 and the signals; rows without
    a match are no results unless nothing is asked. The weight adds quality,
    recency and the kind of page. filters: content_type, source, ingestion
    (ingested or unreviewed), quality (90_plus, 70_89, 50_69, under_50),
    recency (past_hour, past_day, past_week, older). The limit is the page's
    size, from 1 to 100; ties go to the smaller key.
    """
    made = docs.withColumn("_words", tx.words(F.col("text"))).withColumn("_low", F.lower(tx.text_of(F.col("text"))))
    points = F.lit(0.0)
    if asked.terms:
        scored = bm25_scores(docs, key, "text", list(asked.weights), weights=asked.weights).withColumnRenamed("score", "_bm25")
        made = made.join(scored, key, "left")
        signals = match_signals(F.col("_words"), F.col("_low"), F.col("topics"), F.col("entities"), asked, semantics, F.col("own") if semantics else None)
        points = reduce(lambda a, b: a + b, signals.values(), BM25 * F.coalesce("_bm25", F.lit(0.0)))
        # A text without words has no match.
        points = F.when(F.size("_words") > 0, F.greatest(F.lit(0.0), points)).otherwise(0.0)
    made = made.withColumn("match", points)
    if asked.terms:
        made = made.where("match > 0")
    made = made.withColumn("weight", F.coalesce("quality", F.lit(0.0)) + F.col("match") + recency(F.col("fetched_at"), as_of) + kind_points(F.col("content_type")))
    for name, wanted in (filters or {}).items():
        made = made.where(_filter(name, wanted, as_of))
    best = made.select(key, F.round("match", 6).alias("match"), F.round("weight", 6).alias("weight"))
    return best.orderBy(F.desc("weight"), key).limit(max(1, min(100, limit)))


def _filter(name: str, wanted: str, as_of: str) -> Column:
    if name == "content_type":
        return F.when(F.trim(F.coalesce("content_type", F.lit(""))) == "", "page").otherwise(F.trim("content_type")) == wanted
    if name == "source":
        return F.trim("domain") == wanted
    if name == "ingestion":
        return F.coalesce("ingest", F.lit(False)) == F.lit(wanted == "ingested")
    if name == "quality":
        q = F.coalesce("quality", F.lit(0.0))
        return F.when(q >= 90, "90_plus").when(q >= 70, "70_89").when(q >= 50, "50_69").otherwise("under_50") == wanted
    if name == "recency":
        age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("fetched_at").cast("timestamp"), F.lit(as_of).cast("timestamp")))
        return F.when(age <= 3600, "past_hour").when(age <= 86400, "past_day").when(age <= 604800, "past_week").otherwise("older") == wanted
    raise ValueError(f"unknown filter: {name}")

"""BM25 ranking over a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import words


def _count_of(term: str) -> Column:
    return F.size(F.filter("_w", lambda w: w == F.lit(term))).cast("double")


def bm25_scores(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.5, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """Score of each document that holds a term; idf and average length are those of all non-empty texts. weights: what each term counts, 1 by default.

    Null and empty texts have no score; an empty table gives no rows. Only the
    counts of the terms leave a row, so nothing but one number a document and
    term is shuffled. Columns: key, score.
    """
    counts = (
        docs.select(F.col(key), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
        .select(key, F.size("_w").cast("double").alias("_n"), *[_count_of(t).alias(f"_f{i}") for i, t in enumerate(terms)])
    )
    stats = counts.agg(F.count("*").cast("double").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"_d{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + F.greatest((F.col("_docs") - d + 0.5) / (d + 0.5), F.lit(1e-6)))
        norm = k1 * ((1 - b) + b * F.col("_n") / F.col("_avg"))
        parts.append(F.when(f > 0, (weights or {}).get(terms[i], 1.0) * idf * f * (k1 + 1) / F.greatest(f + norm, F.lit(1e-6))).otherwise(0.0))
    held = counts.where(" OR ".join(f"_f{i} > 0" for i in range(len(terms))))
    return held.crossJoin(F.broadcast(stats)).select(key, F.round(sum(parts[1:], parts[0]), 6).alias("score"))

"""The inverted index: postings, lengths, statistics and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import index_terms

TITLE_WEIGHT, LEDE_WEIGHT = 3, 2


def postings(docs: DataFrame, key: str, title: str, lede: str) -> DataFrame:
    """Columns key, term, wtf: 3 for each occurrence in the title and 2 for each in the lede."""

    def part(text: str, weight: int) -> DataFrame:
        return docs.select(key, F.explode(index_terms(F.col(text))).alias("term"), F.lit(weight).alias("_w"))

    return part(title, TITLE_WEIGHT).unionAll(part(lede, LEDE_WEIGHT)).groupBy(key, "term").agg(F.sum("_w").alias("wtf"))


def lengths(docs: DataFrame, key: str, title: str, lede: str) -> DataFrame:
    """Columns key and length, the number of index terms."""
    return docs.select(key, (F.size(index_terms(F.col(title))) + F.size(index_terms(F.col(lede)))).alias("length"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row: n_docs and avg_length, the mean of lengths of at least 1, itself at least 1."""
    return lens.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg(F.greatest(F.lit(1), F.col("length"))), F.lit(1.0))).alias("avg_length"))


def term_stats(post: DataFrame) -> DataFrame:
    """Columns term, df, total weight."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("wtf").alias("total_wtf"))


def weighted_bm25(docs: DataFrame, key: str, title: str, lede: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Columns key and bm25 over weighted term frequencies; rows without a term have no score.

    Term counts of the query are taken beside each document, so postings of
    other terms are neither built nor shuffled; the statistics are one row.
    """

    def count(terms_of: str, term: str) -> Column:
        return F.size(F.filter(terms_of, lambda w: w == F.lit(term)))

    # The terms are made once; a projection that is used several times is not merged into the next.
    made = docs.select(key, index_terms(F.col(title)).alias("_t"), index_terms(F.col(lede)).alias("_l"))
    each = made.select(
        key, F.greatest(F.lit(1), F.size("_t") + F.size("_l")).alias("_n"),
        *[(TITLE_WEIGHT * count("_t", t) + LEDE_WEIGHT * count("_l", t)).alias(f"_f{i}") for i, t in enumerate(terms)],
    )
    stats = each.agg(F.count("*").alias("_docs"), F.greatest(F.lit(1.0), F.avg("_n")).alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    norm = (1 - b) + b * F.col("_n") / F.col("_avg")
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        score = score + F.when(f > 0, F.log((F.col("_docs") - d + 0.5) / (d + 0.5) + 1) * f * (k1 + 1) / (f + k1 * norm)).otherwise(0.0)
    return each.where(" OR ".join(f"_f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats)).select(key, score.alias("bm25"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns facet, value, n: the rows of each value of each column, in one aggregation."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_f")).groupBy("_f.facet", "_f.value").agg(F.count("*").alias("n"))

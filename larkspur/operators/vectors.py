"""Nearest vectors of a set of queries, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries of a block: their product of similarities is what a task holds.
ROWS, QUERIES = 20_000, 512


def nearest(df: DataFrame, key: str, vector: str, queries: Column, k: int) -> DataFrame:
    """Columns query, rank, key, score: the k vectors with the highest cosine to each query row, itself left out.

    Every query meets every row once: rows and queries are hashed into blocks,
    each pair of blocks is one matrix product, and only its k best a query
    leave the task. Null, zero and empty vectors are neither found nor asked;
    vectors must be of one length. Ties go to the smaller key.
    """
    some = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_k"), F.col(vector).cast("array<double>").alias("_v"), queries.alias("_q"))
    sizes = some.agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    rb, qb = max(1, -(-sizes["n"] // ROWS)), max(1, -(-sizes["q"] // QUERIES))
    blocks = F.xxhash64("_k")
    rows = some.select("_k", "_v", F.pmod(blocks, F.lit(rb).cast("bigint")).alias("_rb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qb - 1).cast("bigint"))).alias("_qb"))
    asked = some.where("_q").select("_k", "_v", F.pmod(blocks, F.lit(qb).cast("bigint")).alias("_qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rb - 1).cast("bigint"))).alias("_rb"))

    def unit(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        part = part.sort_values("_k", kind="stable")
        vectors = np.array([np.asarray(v, float) for v in part["_v"] if len(v)], dtype=float).reshape(-1, max([len(v) for v in part["_v"]], default=0))
        keys = part["_k"].to_numpy()[[len(v) > 0 for v in part["_v"]]]
        norm = np.linalg.norm(vectors, axis=1)
        return keys[norm > 0], vectors[norm > 0] / norm[norm > 0, None]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            (keys, a), (names, b) = unit(left), unit(right)
            if len(keys) and len(names):
                scores = b @ a.T
                for name, line in zip(names.tolist(), scores):
                    line = np.where(keys == name, -np.inf, np.round(line, 12))
                    # Keys are in order, so a stable sort puts the smaller first among equals.
                    for at in np.argsort(-line, kind="stable")[:k]:
                        if np.isfinite(line[at]):
                            out.append((name, int(keys[at]), float(line[at])))
        return pd.DataFrame(out, columns=["query", "_k", "score"])

    found = rows.groupBy("_rb", "_qb").cogroup(asked.groupBy("_rb", "_qb")).applyInPandas(best, "query bigint, _k bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "_k"))).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.col("_k").alias(key), "score")

"""Near-duplicates by fingerprint: pairs within a block, and the records that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.sketch import hamming
from larkspur.sources.tables import Rounds, written


def classes(df: DataFrame, key: str, simhash: str, block: str) -> DataFrame:
    """Columns block, simhash, first (the smallest key), size of each fingerprint within its block; null fingerprints are left out."""
    return df.where(F.col(simhash).isNotNull()).groupBy(F.col(block).alias("block"), F.col(simhash).alias("simhash")).agg(F.min(key).alias("first"), F.count("*").alias("size"))


def close_pairs(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Columns a < b and distance: classes of one block, named by their first keys, whose fingerprints differ in at most so many bits.

    nodes are classes(): copies of a fingerprint are one node, so a hot one is
    joined once. The 16 hex digits are cut into distance + 2 bands; by the
    pigeonhole principle close fingerprints agree in two, so pairs of bands
    are joined by equality and no block is multiplied out.
    """
    bands = distance + 2
    cuts = [round(16 * i / bands) for i in range(bands + 1)]
    one = [F.substring("simhash", lo + 1, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
    parts = F.array(*[F.struct(F.lit(f"{i}-{j}").alias("i"), F.concat(one[i], one[j]).alias("v")) for i in range(bands) for j in range(i)])
    each = nodes.select("block", "first", "simhash", F.explode(parts).alias("_band"))
    left = each.select("block", "_band", F.col("first").alias("a"), F.col("simhash").alias("_x"))
    right = each.select("block", "_band", F.col("first").alias("b"), F.col("simhash").alias("_y"))
    near = left.join(right, ["block", "_band"]).where("a < b").withColumn("distance", hamming(F.col("_x"), F.col("_y")))
    return near.where(F.col("distance") <= distance).select("a", "b", "distance").distinct()


def suppressed(df: DataFrame, key: str, simhash: str, block: str, distance: int = 4) -> DataFrame:
    """Column key: rows with a close row of their block before them, whatever became of that one."""
    nodes = classes(df, key, simhash, block)
    before = close_pairs(nodes, distance)
    least = before.groupBy(F.col("b").alias("first")).agg(F.min("a").alias("_least"))
    # A class that is later by its first row may still come before another's later copies.
    after = before.groupBy(F.col("a").alias("first")).agg(F.min("b").alias("_other"))
    known = nodes.join(least, "first", "left").join(after, "first", "left").select("block", F.col("simhash").alias("_s"), F.least("first", "_least", "_other").alias("_least"))
    rows = df.where(F.col(simhash).isNotNull()).select(F.col(block).alias("block"), F.col(simhash).alias("_s"), key)
    return rows.join(known, ["block", "_s"]).where(F.col("_least") < F.col(key)).select(key)


def first_wins(pairs: DataFrame) -> DataFrame:
    """Column dropped: the greedy, order-dependent resolution of pairs a < b of classes.

    In order of the key a row is dropped if a row before it is close and was
    not dropped itself. Rounds decide all rows at once whose earlier
    neighbours are decided; as many as the longest chain of close rows. Copies
    of a class after its first row are always dropped, so the first stand for all.
    """
    spark = pairs.sparkSession
    rounds = Rounds(spark, "close")
    edges = rounds.next(pairs.select("a", "b"))
    dropped = edges.select(F.col("b").alias("n")).limit(0)
    while True:
        # Kept for certain: rows that no open edge comes into. What they touch is dropped.
        kept = edges.select(F.col("a").alias("n")).distinct().join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_anti")
        new = written(edges.join(kept.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct(), "dropped")
        dropped = dropped.union(new)
        open_edges = edges.join(kept.withColumnRenamed("n", "a"), "a", "left_anti").join(new.withColumnRenamed("n", "a"), "a", "left_anti").join(new.withColumnRenamed("n", "b"), "b", "left_anti")
        edges = rounds.next(open_edges.select("a", "b"))
        if edges.isEmpty():
            return dropped.select(F.col("n").alias("dropped"))


def collapsed(df: DataFrame, key: str, score: str, simhash: str, distance: int = 4) -> DataFrame:
    """Columns key and collapsed: the rows that stay when results are taken from the best score on, and how many each stands for besides itself.

    A row goes if a better row that stays has a fingerprint at most so many
    bits away; of equal scores the smaller key is better. Rows without a
    fingerprint stay. A row that goes counts with the best row that keeps it out.
    """
    best = F.max(F.struct(F.col(score).alias("_score"), (-F.col(key)).alias("_minus")))
    nodes = written(df.where(F.col(simhash).isNotNull()).groupBy(F.col(simhash).alias("simhash")).agg(best.alias("_b"), F.count("*").alias("size")).select(F.lit(0).alias("block"), "simhash", (-F.col("_b._minus")).alias("first"), F.col("_b._score").alias("_score"), "size"), "results")
    near = close_pairs(nodes, distance)
    order = nodes.select("first", "_score")
    scored = near.join(order.toDF("a", "_sa"), "a").join(order.toDF("b", "_sb"), "b")
    ahead = (F.col("_sa") > F.col("_sb")) | ((F.col("_sa") == F.col("_sb")) & (F.col("a") < F.col("b")))
    edges = written(scored.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("_sa", "_sb").alias("_score")), "ahead")
    gone = first_wins(edges).select(F.col("dropped").alias("b"))
    # Each class that goes, with the best staying one before it.
    to = edges.join(gone, "b", "left_semi").join(gone.select(F.col("b").alias("a")), "a", "left_anti").groupBy("b").agg(F.max(F.struct("_score", (-F.col("a")).alias("_m"))).alias("_k"))
    others = to.join(nodes.select(F.col("first").alias("b"), "size"), "b").groupBy((-F.col("_k._m")).alias("first")).agg(F.sum("size").alias("_n"))
    held = nodes.join(gone.withColumnRenamed("b", "first"), "first", "left_anti").join(others, "first", "left").select(F.col("first").alias(key), (F.col("size") - 1 + F.coalesce("_n", F.lit(0))).alias("collapsed"))
    return held.unionByName(df.where(F.col(simhash).isNull()).select(key, F.lit(0).cast("bigint").alias("collapsed")))

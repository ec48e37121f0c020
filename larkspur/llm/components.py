"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.tables import Rounds

_EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node and root (the smallest node of its component) of every node that has an edge.

    Loops make a component of one node, repeated edges count once, edges with a
    null end are left out, and no edges give no rows. Each round is written to
    the shared folder and replaces the one before; rounds end when the edges
    are stars already. The least neighbour of a node is an aggregation that
    combines before its exchange, and goes back to the edges by a join that
    adaptive execution can split, so a hub is never one task's work.
    """
    rounds = Rounds(edges.sparkSession, "edges")
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = rounds.next(pairs.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).distinct())
    before = _mark(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ordered = large.union(now.where("u = v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _towards_least(ordered)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        # An edge from a node to itself says nothing, unless the node is a root.
        now = rounds.next(after)
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _towards_least(edges: DataFrame) -> DataFrame:
    """u, v and m: the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "_least").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

"""The link graph: ledger, authority, parents, reachability and revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.tables import written

BASELINE = 0.52


def ledger(links: DataFrame, src: str, dst: str, seen: str) -> DataFrame:
    """Columns src, dst, count, first_seen, last_seen of each link."""
    return links.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("count"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def page_authority(led: DataFrame, trust: Column, own: Column) -> DataFrame:
    """Columns dst, inbound, sources, authority: own trust + min(.25, .05 sources) + min(.4, ln(1 + sum of trust ln(1 + count)) / 3), within 0 and 1."""
    each = led.groupBy("dst").agg(F.sum("count").alias("inbound"), F.count_distinct("src").alias("sources"), F.sum(trust * F.log1p("count")).alias("_w"), F.max(own).alias("_b"))
    score = F.col("_b") + F.least(F.lit(0.25), 0.05 * F.col("sources")) + F.when(F.col("_w") > 0, F.least(F.lit(0.4), F.log1p("_w") / 3)).otherwise(0.0)
    return each.select("dst", "inbound", "sources", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("authority"))


def parents(led: DataFrame) -> DataFrame:
    """Columns dst, parent: the source with most links to it, of equals the first by name."""
    best = led.groupBy("dst").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("src").alias("src"))).alias("b"))
    return best.select("dst", F.col("b.src").alias("parent"))


def reachable(edges: DataFrame, src: str, dst: str, seeds: DataFrame, depth: int) -> DataFrame:
    """Columns node, depth: nodes at most so many steps from the seeds (one column), with the fewest steps.

    Breadth first, a join a level; the edges are written once and each level as well, and only new nodes go on.
    """
    steps = written(edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).where("_s IS NOT NULL AND node IS NOT NULL").distinct(), "steps")
    front = written(seeds.toDF("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "front")
    found = front
    for level in range(1, depth + 1):
        new = front.withColumnRenamed("node", "_s").join(steps, "_s").select("node").distinct().join(found.select("node"), "node", "left_anti")
        front = written(new.withColumn("depth", F.lit(level)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def crawled(edges: DataFrame, src: str, dst: str, seeds: list[str], depth: int, host: Callable[[Column], Column], limit: int, across: bool = False) -> DataFrame:
    """Columns node, depth, place: the pages a crawl takes in order of depth and address, at most so many.

    Links to another host than that of a seed are followed only if across;
    the limit is the crawl's own bound.
    """
    spark = edges.sparkSession
    roots = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "node string")
    # A crawl has few seeds.
    kept = edges if across else edges.join(F.broadcast(roots.select(host(F.col("node")).alias("_h")).distinct()), host(F.col(dst)) == F.col("_h"), "left_semi")
    found = reachable(kept, src, dst, roots, depth).orderBy("depth", "node").limit(limit)
    return found.withColumn("place", F.row_number().over(Window.orderBy("depth", "node")))


def revisions(pages: DataFrame, page: str, moment: str, tie: str, digest: Column, items: Column) -> DataFrame:
    """Each version whose content differs from the one before: page, revision (from 1), tie, added, removed.

    added and removed are the distinct items gained and lost against the
    version before; null items count as none.
    """
    order = Window.partitionBy(page).orderBy(moment, tie)
    now = F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))
    each = pages.select(page, moment, tie, digest.alias("_d"), now.alias("_i")).withColumn("_before", F.lag("_d").over(order)).withColumn("_prior", F.lag("_i").over(order))
    changed = each.withColumn("_new", F.col("_before").isNull() | (F.col("_before") != F.col("_d")))
    numbered = changed.withColumn("revision", F.sum(F.col("_new").cast("int")).over(order)).where("_new")
    none = F.array().cast("array<string>")
    prior = F.coalesce("_prior", none)
    return numbered.select(page, "revision", tie, F.array_sort(F.array_except("_i", prior)).alias("added"), F.array_sort(F.array_except(prior, F.col("_i"))).alias("removed"))


def cadence(events: DataFrame, key: str, moment: str) -> DataFrame:
    """Columns key, samples, minutes: the median minutes between events, at least 5; keys with one event are left out."""
    gap = F.timestamp_diff("SECOND", F.lag(F.col(moment).cast("timestamp")).over(Window.partitionBy(key).orderBy(moment)), F.col(moment).cast("timestamp")) / 60
    gaps = events.where(F.col(moment).isNotNull()).select(key, moment).withColumn("_gap", gap).where("_gap IS NOT NULL")
    return gaps.groupBy(key).agg(F.count("*").alias("samples"), F.greatest(F.lit(5.0), F.median("_gap")).alias("minutes"))

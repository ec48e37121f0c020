"""Distributional semantics: windowed co-occurrence, PPMI and cosine pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larkspur.sources.tables import release, written


def cooccurrence(tokens: DataFrame, doc: str, words: str, radius: int, decay: str = "inverse", strength: float | None = None) -> DataFrame:
    """Columns target, context, weight: summed weights of neighbours at most radius places apart, both ways.

    words is a column of arrays, of texts or of numbers. The weight at a distance is 1 / distance^s
    (inverse, s = 1 by default) or 1 - s (distance - 1), at least 0 (linear,
    s = 1 / radius by default). Null and empty tokens take their place but
    count with nothing. Pairs are made inside a row and summed before the
    shuffle.
    """
    if decay not in ("inverse", "linear"):
        raise ValueError(f"unknown decay: {decay}")
    s = (1.0 if decay == "inverse" else 1.0 / radius) if strength is None else strength
    if s < 0:
        raise ValueError("the decay's strength is at least 0")
    weights = [max(0.0, 1.0 - s * (d - 1)) if decay == "linear" else 1.0 / d**s for d in range(1, radius + 1)]
    some = tokens.where(F.size(words) > 1).select(F.col(words).alias("_w"))
    parts = []
    for d, weight in enumerate(weights, 1):
        if weight > 0:
            near = some.where(F.size("_w") > d).select(F.explode(F.arrays_zip(F.slice("_w", 1, F.size("_w") - d).alias("a"), F.slice("_w", d + 1, F.size("_w") - d).alias("b"))).alias("_p"))
            parts.append(near.select(F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), F.lit(weight).alias("w")))
    if not parts:
        return some.select(F.lit("").alias("target"), F.lit("").alias("context"), F.lit(0.0).alias("weight")).limit(0)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    texts = isinstance(some.schema["_w"].dataType.elementType, T.StringType)
    every = every.where("a <> '' AND b <> ''" if texts else "a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return every.select(F.explode(F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("context")), F.struct(F.col("b").alias("target"), F.col("a").alias("context")))).alias("_p"), "w").groupBy("_p.target", "_p.context").agg(F.sum("w").alias("weight"))


def ppmi(counts: DataFrame) -> DataFrame:
    """Columns target, context, ppmi = ln(weight total / (row sum * column sum)), where that is above 0."""
    rows = counts.groupBy("target").agg(F.sum("weight").alias("_r"))
    cols = counts.groupBy("context").agg(F.sum("weight").alias("_c"))
    total = counts.agg(F.sum("weight").alias("_n"))
    value = F.log(F.col("weight") * F.col("_n") / (F.col("_r") * F.col("_c")))
    return counts.join(rows, "target").join(cols, "context").crossJoin(F.broadcast(total)).select("target", "context", value.alias("ppmi")).where("ppmi > 0")


def cosine_pairs(vectors: DataFrame, row: str, column: str, value: str, least: float = 0.0) -> DataFrame:
    """Columns left < right, score: cosine of sparse rows with values of at least 0 that share a column, of at least the score."""
    rows = _rows(vectors, row, column, value)
    members = rows.select("_c", F.col("_r").alias("_name"))
    first = rows.groupBy("_c").agg(F.min_by(F.struct("_r", "_norm", "_n"), "_r").alias("_p")).select("_c", "_p.*")
    entries = _entries(vectors, row, column, value, first)
    return _listed(_close(entries, least), members).where(F.col("score") >= least)


def most_similar(vectors: DataFrame, row: str, column: str, value: str, names: DataFrame, k: int, least: float = 0.0, digits: int = 9) -> DataFrame:
    """Columns left < right, score: the k pairs of cosine_pairs() that come first by score, rounded to so many digits, and by names.

    names has the rows and their names, each once. Of rows with equal vectors
    only the first k + 1 by name can be in such a pair: for any further one k
    others make a pair of the same score that comes before. Pairs are sought
    with a score of 1 first, and with lower ones only where those are fewer
    than k; what is found at a level is whole, with all ties.
    """
    rows = _rows(vectors, row, column, value)
    named = rows.join(names.toDF("_r", "_name"), "_r")
    members = written(named.withColumn("_at", F.row_number().over(Window.partitionBy("_c").orderBy("_name"))).where(F.col("_at") <= k + 1), "members")
    entries = _entries(vectors, row, column, value, members.where("_at = 1"))
    release(vectors.sparkSession)
    equal = members.groupBy("_c").count().agg(F.sum(F.expr("count * (count - 1) / 2")).alias("n")).first()["n"] or 0
    members = members.select("_c", "_name")
    for level in [x for x in (1.0, 0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3) if x > least] + [least]:
        close = _close(entries, max(least, level - 10.0**-digits))
        if level > least and equal < k:
            close = written(close, "close")
            if equal + _listed(close, members, equal=False).where(F.round("score", digits) >= level).count() < k:
                continue
        break
    found = _listed(close, members).where(F.col("score") >= least)
    return found.orderBy(F.desc(F.round("score", digits)), "left", "right").limit(k)


def _rows(vectors: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Columns _r, _norm, _n, _c: each row with its length and number of entries; rows with equal entries have one _c, a 64-bit hash."""
    same = F.xxhash64(F.bit_xor(F.xxhash64(column, value)), F.bit_xor(F.xxhash64(value, column)), F.count("*"))
    rows = vectors.groupBy(F.col(row).alias("_r")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"), F.count("*").alias("_n"), same.alias("_c"))
    return written(rows.where("_norm > 0"), "rows")


def _entries(vectors: DataFrame, row: str, column: str, value: str, first: DataFrame) -> DataFrame:
    """Columns _c, _n, _k, _v: the entries, as parts of the length, of one row a class."""
    unit = vectors.select(F.col(row).alias("_r"), F.xxhash64(column).alias("_k"), F.col(value).alias("_v")).join(first.select("_r", "_c", "_n", "_norm"), "_r")
    return written(unit.select("_c", "_n", "_k", (F.col("_v") / F.col("_norm")).alias("_v")), "units")


def _close(entries: DataFrame, least: float) -> DataFrame:
    """Columns _x < _y, score: pairs of classes that share a column, with a cosine of at least the score.

    Columns are ordered by the number of classes that have them, and a class is
    indexed under its rarest ones, until what is left of it is shorter than
    the least score: classes that share nothing but what is left cannot reach it.
    A pair meets in the first column it shares if its values there, which differ
    by at most sqrt(2 - 2 least), and what is left of both behind it can reach
    the score; then the shorter one's entries are looked up in the longer.
    """
    order = Window.partitionBy("_c").orderBy("_f", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = entries.join(entries.groupBy("_k").agg(F.count("*").alias("_f")), "_k")
    summed = counted.withColumn("_s", F.sum(F.col("_v") * F.col("_v")).over(order))
    kept = summed.where(1 - F.col("_s") + F.col("_v") * F.col("_v") >= (least - 1e-9) * abs(least - 1e-9))
    apart = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    place = F.floor(F.col("_v") / apart).cast("bigint") if apart < 0.5 else F.lit(0).cast("bigint")
    index = written(kept.select("_k", place.alias("_b"), "_c", "_n", "_v", F.greatest(F.lit(0.0), 1 - F.col("_s")).alias("_l")), "index")
    near = index.withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1))) if apart < 0.5 else index
    a, b = near.toDF("_k", "_b", "_x", "_m", "_v", "_l"), index.toDF("_k", "_b", "_y", "_n", "_w", "_r")
    # Less than the least score by what rounding may take from the root.
    met = a.join(b, ["_k", "_b"]).where(F.col("_x") < F.col("_y")).where(F.col("_v") * F.col("_w") + F.sqrt(F.col("_l") * F.col("_r")) >= least - 1e-6)
    short = F.col("_m") <= F.col("_n")
    pairs = met.select(F.when(short, F.col("_x")).otherwise(F.col("_y")).alias("_p"), F.when(short, F.col("_y")).otherwise(F.col("_x")).alias("_q")).distinct()
    whole = entries.select("_c", "_k", "_v")
    each = pairs.join(whole.toDF("_p", "_k", "_v"), "_p").join(whole.toDF("_q", "_k", "_w"), ["_q", "_k"])
    scored = each.groupBy("_p", "_q").agg(F.sum(F.col("_v") * F.col("_w")).alias("score")).where(F.col("score") >= least)
    return scored.select(F.least("_p", "_q").alias("_x"), F.greatest("_p", "_q").alias("_y"), "score")


def _listed(close: DataFrame, members: DataFrame, equal: bool = True) -> DataFrame:
    """Columns left < right, score: the pairs of members of close classes and, if equal, of one class."""
    a, b = members.toDF("_x", "_p"), members.toDF("_y", "_q")
    pairs = close.join(a, "_x").join(b, "_y").select(F.least("_p", "_q").alias("left"), F.greatest("_p", "_q").alias("right"), "score")
    if not equal:
        return pairs
    return pairs.unionAll(a.join(b, F.col("_x") == F.col("_y")).where("_p < _q").select("_p", "_q", F.lit(1.0)))

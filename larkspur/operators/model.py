"""The logistic model: scores, contributions and training."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def logit(weights: dict[str, float], bias: float) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in weights.items()], F.lit(float(bias)))


def predict(weights: dict[str, float], bias: float) -> Column:
    """1 / (1 + e^-z); null features count as 0."""
    return 1 / (1 + F.exp(-logit(weights, bias)))


def label_of(score: Column) -> Column:
    return F.when(score >= 0.75, "strong").when(score >= 0.55, "promising").when(score >= 0.35, "emerging").otherwise("weak")


def train(samples: DataFrame, features: list[str], label: str, iterations: int = 120, rate: float = 0.15) -> tuple[dict[str, float], float]:
    """Weights and bias by gradient descent from zero: sum of (p - y) x / n a round.

    The data stay where they are: rows of equal features are counted once, and
    every round is one aggregation that brings back one row of gradients.
    """
    rows = samples.where(F.col(label).isNotNull()).groupBy(*[F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).agg(F.count("*").alias("_n")).cache()
    try:
        n = rows.agg(F.sum("_n")).first()[0] or 0
        weights, bias = dict.fromkeys(features, 0.0), 0.0
        if not n:
            return weights, bias
        for _ in range(iterations):
            error = (predict(weights, bias) - F.col("_y")) * F.col("_n")
            step = rows.agg(F.sum(error).alias("b"), *[F.sum(error * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)]).first()
            bias -= rate * step["b"] / n
            weights = {f: w - rate * step[f"g{i}"] / n for i, (f, w) in enumerate(weights.items())}
        return weights, bias
    finally:
        rows.unpersist()


def version(weights: dict[str, float], bias: float) -> str:
    """A digest of the model's numbers."""
    return hashlib.sha256(json.dumps({"bias": bias, "weights": weights}, sort_keys=True).encode()).hexdigest()


def save(spark: SparkSession, path: str, weights: dict[str, float], bias: float) -> str:
    """Writes the model as JSON with its version, which is returned."""
    name = version(weights, bias)
    text = json.dumps({"bias": bias, "weights": weights, "version": name}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return name


def load(spark: SparkSession, path: str, default: tuple[dict[str, float], float] | None = None) -> tuple[dict[str, float], float]:
    """The model of a folder; the default, if there is one, where the folder holds none."""
    try:
        held = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except Exception as e:
        if default is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return default
    return {f: float(w) for f, w in held["weights"].items()}, float(held["bias"])

"""Merging of records by key: upserts, unions and full outer merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order, without a window over the rows: one aggregation of a struct."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_fields(df: DataFrame, key: str, order: Column, first: list[str], most: list[str], any_of: list[str], lists: list[str]) -> DataFrame:
    """One row a key: of first columns the first value that is neither null nor '', of most the maximum, of any_of whether one is true, of lists the sorted distinct items."""
    aggs = [F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)).alias(c) for c in first]
    aggs += [F.max(c).alias(c) for c in most] + [F.bool_or(c).alias(c) for c in any_of]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    return df.groupBy(key).agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of rows of old with their keys, and all others of both; of repeats in new any one stays."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)

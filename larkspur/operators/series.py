"""Time series: returns, volatility, momentum and rolling measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sessions of each horizon.
HORIZONS = {"one_week": 5, "one_month": 21, "three_month": 63, "six_month": 126}


def returns(prices: DataFrame, key: str, moment: str, close: str) -> DataFrame:
    """Columns key and a return in percent for each horizon, from the latest close against that many sessions before, at most the first.

    Null closes are left out; a base of zero gives 0.
    """
    by = Window.partitionBy(key).orderBy(F.desc(moment))
    ranked = prices.where(F.col(close).isNotNull()).select(key, F.col(close).alias("_c"), (F.row_number().over(by) - 1).alias("_back"))
    last = F.max(F.when(F.col("_back") == 0, F.col("_c")))
    sums = [F.min_by("_c", F.when(F.col("_back") <= n, -F.col("_back"))).alias(f"_{name}") for name, n in HORIZONS.items()]
    each = ranked.groupBy(key).agg(last.alias("_l"), *sums)
    return each.select(key, *[F.when(F.col(f"_{h}") == 0, 0.0).otherwise((F.col("_l") - F.col(f"_{h}")) / F.col(f"_{h}") * 100).alias(h) for h in HORIZONS])


def volatility(prices: DataFrame, key: str, moment: str, close: str, window: int = 30) -> DataFrame:
    """Columns key, volatility: population deviation of the last returns, a year's worth, in percent; 0 without a return.

    Returns on a base of zero are skipped.
    """
    order = Window.partitionBy(key).orderBy(moment)
    prior = F.lag(close).over(order)
    each = prices.where(F.col(close).isNotNull()).select(key, moment, F.when(prior != 0, (F.col(close) - prior) / prior).alias("_r"))
    recent = each.where("_r IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(moment)))).where(F.col("_n") <= window)
    found = recent.groupBy(key).agg((F.stddev_pop("_r") * (252**0.5) * 100).alias("volatility"))
    return prices.select(key).distinct().join(found, key, "left").select(key, F.coalesce("volatility", F.lit(0.0)).alias("volatility"))

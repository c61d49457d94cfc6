"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot if it holds more than 2/HOT_KEYS of the rows, so there are fewer than HOT_KEYS / 2 of them.
HOT_KEYS = 1000
#: Left rows up to which one task could hold them all, so that no key needs care.
PLAIN_ROWS = 200_000


def hot_keys(left: DataFrame, key: str, n_left: int) -> DataFrame:
    """Keys with more than 2/HOT_KEYS of the ``n_left`` rows: fewer than HOT_KEYS/2 rows, whatever the data."""
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(2 * n_left // HOT_KEYS, 1000)).select(key)


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str, n_left: int, spread: Column, hot: DataFrame | None = None, plain_rows: int | None = None) -> DataFrame:
    """Left outer join on a unique right key that adds ``value``; balanced even if one key holds most left rows.

    The right rows of hot keys are broadcast (their number is bounded by HOT_KEYS / 2). Left rows served that way go
    through the shuffled join under a key made from ``spread``, so no partition collects them. ``hot`` may be given if
    the caller knows the hot keys (column ``right_key``) already. Null keys get a null value. Up to ``plain_rows`` (else PLAIN_ROWS)
    left rows the plan is a plain join with the same result.
    """
    if n_left <= (PLAIN_ROWS if plain_rows is None else plain_rows):
        return left.join(right.select(F.col(right_key).alias("_rk"), F.col(value)), F.col(key) == F.col("_rk"), "left").drop("_rk")
    hot = hot_keys(left.filter(F.col(key).isNotNull()), key, n_left).withColumnRenamed(key, right_key) if hot is None else hot
    small = right.join(F.broadcast(hot), right_key, "left_semi").select(F.col(right_key).alias("_hk"), F.col(value).alias("_hv"), F.lit(True).alias("_hit"))
    big = right.select(F.col(right_key).alias("_rk"), F.col(value).alias("_rv"))
    out = left.join(F.broadcast(small), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hit") | F.col(key).isNull(), spread).otherwise(F.col(key)))
    out = out.join(big, F.col("_jk") == F.col("_rk"), "left")
    out = out.withColumn(value, F.when(F.col("_hit"), F.col("_hv")).when(F.col(key).isNotNull(), F.col("_rv")))
    return out.drop("_hk", "_hv", "_hit", "_jk", "_rk", "_rv")

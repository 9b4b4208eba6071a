"""Joins that refuse a right side whose key repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, refused in the job that reads it when a value of ``key`` stands
    more than once; a NULL key joins nothing and may repeat.

    The check is a scalar subquery over the key column alone.  An aggregate or
    a window on ``df`` itself could share the join's exchange, but Spark splits
    a skewed partition only where the join reads the exchange directly, and the
    other side of these joins may have a third of its rows on one key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.where("n > 1").agg(F.min("k").cast("string").alias("k")).scalar()
    refuse = F.raise_error(F.concat(F.lit(f"Not many-to-one, {key} repeats: "), repeated)).cast("boolean")
    return df.where(F.when(repeated.isNotNull(), refuse).otherwise(True))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, refused when a key of ``right``
    stands more than once."""
    return left.join(unique_key(right, key), key)

"""Globally ordered operators without a single-partition window.

``Window.orderBy`` with no partition moves every row into one task.  Both
helpers here cut the key's range into buckets, use windows inside each, and
combine a summary with one row for each bucket at the end.

The bounds between buckets are quantiles of a bounded sample of the keys: the
``SAMPLE_PER_BUCKET`` x buckets keys whose hashes are the smallest.  They
enter as one scalar subquery, an array literal by the time rows are read, so
the rows are exchanged once, by bucket, and nothing runs while the query is
built.  The sample is a function of the keys alone: every branch of a plan,
and every retry of a task, puts a row into the same bucket.

Keys are the unique ids of a grain; a key that repeats is one bucket's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 64


def _parallelism(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> Column:
    """The ``buckets`` - 1 lower bounds of all buckets but the first (fewer
    where keys are few), as a scalar subquery."""
    sample = (df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
              .orderBy(F.xxhash64("k"), "k").limit(buckets * SAMPLE_PER_BUCKET))
    ordered = sample.agg(F.array_sort(F.collect_list("k")).alias("s"))
    if buckets < 2:
        return ordered.select(F.slice("s", 1, 0)).scalar()
    step = F.size("s") / F.lit(buckets)
    return ordered.select(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("s", F.floor(i * step).cast("int"))))).scalar()


def bucket_of(key: Column, bounds: Column, buckets: int) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by binary
    search; NULL keys come first, as in an ascending sort."""
    steps = [1 << b for b in range(max(1, buckets).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found)


def _bucketed(df: DataFrame, key: str, num_partitions: int | None) -> DataFrame:
    buckets = _parallelism(df, num_partitions)
    return (df.withColumn("_bounds", bucket_bounds(df, key, buckets))
            .withColumn("_bucket", bucket_of(F.col(key), F.col("_bounds"), buckets)).drop("_bounds"))


def sequential_key(df: DataFrame, order_col: str, key_name: str,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``key_name`` = 1..n in ``order_col`` order (ties broken arbitrarily).

    A row's number is its place in its bucket plus the rows of the buckets
    before; those counts have one row for each bucket and are broadcast by
    construction.
    """
    rows = _bucketed(df, order_col, num_partitions)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = (rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order_col))
    return (rows.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
            .withColumn(key_name, F.col("_offset") + F.col("_place")).drop("_bucket", "_offset", "_place"))


def count_order_inversions(df: DataFrame, key: str, values: list[str],
                           num_partitions: int | None = None) -> DataFrame:
    """Count, per value column, rows whose value is below the previous row's
    in ``key`` order (``diff() < 0``, NULL-free input assumed).

    A lag window for each bucket counts the inversions inside it, and one
    summary row per bucket (its first and last value) checks the seams between
    neighbouring buckets.
    """
    rows = _bucketed(df.select(key, *values), key, num_partitions)
    inside = Window.partitionBy("_bucket").orderBy(key)
    flagged = rows.select("_bucket", key, *values,
                          *[(F.col(v) < F.lag(v).over(inside)).alias(f"_inv_{v}") for v in values])
    summary = flagged.groupBy("_bucket").agg(*[
        agg for v in values for agg in (
            F.count_if(f"_inv_{v}").alias(f"{v}__inv"),
            F.min_by(v, key).alias(f"{v}__first"),
            F.max_by(v, key).alias(f"{v}__last"))])
    w = Window.orderBy("_bucket")  # one row per non-empty bucket
    seams = summary.select(*[
        (F.col(f"{v}__inv") + F.when(F.col(f"{v}__first") < F.lag(f"{v}__last").over(w), 1).otherwise(0)
         ).alias(v) for v in values])
    return seams.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(v) for v in values])

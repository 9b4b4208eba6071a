"""Roll-ups of sales over month and country, with exact customer counts.

Distinct counts do not add up, so a roll-up usually goes back to the rows.
Here customers are numbered 1..n, and each (month, country) keeps the set of
its customers as bitmaps, one for each ``bucket`` of 32,768 numbers.  Sets of
months or countries are unions of bitmaps, whose counts are exact; revenue,
orders and units are sums.  So the activity table answers every roll-up, and
no line or invoice is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, money, month_label, safe_div
from tillpoint.functions.ordering import sequential_key

SUMS = ("revenue_cents", "orders", "units", "first_revenue_cents", "later_revenue_cents")
# Which of (month, country) a row is a total over, by the value of grouping_id.
LEVELS = {0: "month and country", 1: "month", 2: "country", 3: "all"}


def activity(invoices_df: DataFrame) -> DataFrame:
    """(month, country, bucket): ``customers`` (bitmap) and the sums of its
    invoices, split into revenue of the customers' first observed month and of
    later ones.  Invoices without a customer are in the NULL bucket.

    Invoices first shrink to (customer, month, country) rows, which combine
    map-side, so a customer or a market with a third of all invoices moves a
    row for each task; all else runs on those rows."""
    cells = invoices_df.groupBy("customer_id", "month", "country").agg(
        F.sum("revenue_cents").alias("revenue_cents"), F.count(F.lit(1)).alias("orders"), F.sum("items").alias("units"))
    first = cells.groupBy("customer_id").agg(F.min("month").alias("first_month"))
    numbered = sequential_key(first.where(F.col("customer_id").isNotNull()), "customer_id", "number")
    own = cells.join(numbered, "customer_id", "left")
    is_first = F.col("month") == F.col("first_month")
    return (own.groupBy("month", "country", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("customers"),
                 *[F.sum(c).cast("bigint").alias(c) for c in SUMS[:3]],
                 F.sum(F.when(is_first, F.col("revenue_cents")).otherwise(0)).cast("bigint").alias("first_revenue_cents"),
                 F.sum(F.when(~is_first, F.col("revenue_cents")).otherwise(0)).cast("bigint").alias("later_revenue_cents")))


def _united() -> list[Column]:
    return [F.bitmap_or_agg("customers").alias("customers"), *[F.sum(c).alias(c) for c in SUMS]]


def _counted() -> list[Column]:
    known = F.when(F.col("bucket").isNotNull(), F.bitmap_count("customers")).otherwise(0)
    return [F.sum(known).alias("active_customers"), *[F.sum(c).cast("bigint").alias(c) for c in SUMS]]


def rolled_up(activity_df: DataFrame, **keys: Column) -> DataFrame:
    """``active_customers`` and the sums for each value of the named ``keys``,
    any expressions over month and country; one row without keys."""
    named = [e.alias(name) for name, e in keys.items()]
    united = activity_df.groupBy(*named, "bucket").agg(*_united())
    return united.groupBy(*keys).agg(*_counted())


def sales_cube(activity_df: DataFrame) -> DataFrame:
    """Totals by month and country, by month, by country and over all, from one
    scan: ``level`` (grouping_id) tells a total from a NULL key."""
    sets = [["month", "country", "bucket"], ["month", "bucket"], ["country", "bucket"], ["bucket"]]
    # grouping_id has a bit for each of month, country, bucket; the last is 0.
    united = (activity_df.groupingSets(sets, "month", "country", "bucket")
              .agg((F.grouping_id() / 2).cast("int").alias("level"), *_united()))
    return united.groupBy("level", "month", "country").agg(*_counted())


def sales_rollup(activity_df: DataFrame) -> DataFrame:
    """The cube as a mart."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("level"))
    return sales_cube(activity_df).select(
        level.alias("level"), month_label("month").alias("month"), "country", "active_customers", "orders", "units",
        money("revenue_cents").alias("revenue"), money("first_revenue_cents").alias("first_observed_month_revenue"),
        money("later_revenue_cents").alias("returning_later_month_revenue"),
        dround(safe_div(money("revenue_cents"), "orders"), 2).alias("aov"))


def quarterly_customers(activity_df: DataFrame) -> DataFrame:
    """Active customers and sales by quarter and country: a customer of several
    months of a quarter counts once."""
    q = rolled_up(activity_df, year=F.year("month"), quarter=F.quarter("month"), country=F.col("country"))
    return q.select(F.col("year").cast("bigint").alias("year"), F.col("quarter").cast("bigint").alias("quarter"), "country",
                    "active_customers", "orders", money("revenue_cents").alias("revenue"))

"""Adapter from the TPC-H style test tables to the invoice-line extract.

Mapping (one invoice line per lineitem row):

* invoice_no   <- orders.o_orderkey
* stock_code   <- part.p_partkey
* product_line <- part.p_brand || '/' || part.p_type   (150; the series that are forecast)
* description  <- part.p_name
* quantity     <- lineitem.l_quantity
* unit_price   <- part.p_retailprice as DECIMAL(14,2)
* customer_id  <- orders.o_custkey
* country      <- nation.n_name of the customer
* invoice_date_text <- o_orderdate with ambiguous day/month swapped, as text

The swap reproduces the extract's corruption; ``repair_dates`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.columns import TS_FORMAT, month_start, swap_day_month
from tillpoint.functions.joins import unique_key
from tillpoint.sources.extract import RAW_SCHEMA


# The tables that lines are joined to, and their keys.
KEYS = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "nation": "n_nationkey"}


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def read_extract(spark: SparkSession, sf_dir: str, many_to_one: bool = False, by_month: bool = False) -> DataFrame:
    """Raw 13-column extract built from the test tables.

    Joins orders x customer on customer key, lineitem x those on order key,
    then part on part key, and ``nation`` (25 rows by definition), the only one
    that is broadcast explicitly; AQE decides for the others from their
    measured sizes.  With ``many_to_one`` a key that repeats in orders,
    part, customer or nation fails the load; else it repeats lines.  Lines without their order, part, customer or
    nation have no invoice and are left out; ``orphan_lines`` counts them.
    ``product_line`` follows the 13 columns of the contract.

    Rows move with keys and dates alone: the columns of a part join last, and
    all that follows from a row itself (the country's name, the date's text and
    calendar fields) is derived after the last exchange.  With ``by_month``
    that one is a rebalance by month, for a table clustered by it.
    """
    t = load_tables(spark, sf_dir, "lineitem", *KEYS)
    if many_to_one:
        t |= {name: unique_key(t[name], key) for name, key in KEYS.items()}
    nation = t["nation"].select("n_nationkey", F.col("n_name").alias("country"))
    customer = t["customer"].select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
    orders = (t["orders"].select(F.col("o_orderkey").alias("invoice_no"),
                                 F.col("o_custkey").alias("customer_id"), "o_orderdate")
              .join(customer, "customer_id"))
    part = t["part"].select(
        F.col("p_partkey").alias("partkey"),
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("product_line"),
        F.col("p_name").alias("description"),
        F.col("p_retailprice").cast("decimal(14,2)").alias("unit_price"))
    items = t["lineitem"].select(F.col("l_orderkey").alias("invoice_no"),
                                 F.col("l_partkey").alias("partkey"),
                                 F.col("l_quantity").cast("int").alias("quantity"))
    rows = items.join(orders, "invoice_no").join(part, "partkey")
    if by_month:
        # The repair gives the order date back, so this is the invoice month.
        rows = rows.withColumn("_month", month_start("o_orderdate")).hint("rebalance", F.col("_month"))
    rows = rows.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    ts = F.col("raw_ts")
    raw = rows.withColumn("raw_ts", swap_day_month("o_orderdate")).select(
        "*", F.col("partkey").cast("string").alias("stock_code"),
        F.date_format(ts, TS_FORMAT).alias("invoice_date_text"),
        F.year(ts).alias("original_year"), F.month(ts).alias("original_month"),
        F.weekofyear(ts).alias("original_week"), F.dayofmonth(ts).alias("original_day"),
        F.weekday(ts).alias("original_weekday"))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields], "product_line")


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the lines, and those that the extract leaves out because their
    order, part, customer or nation is missing."""
    t = load_tables(spark, sf_dir, "orders", "lineitem", "part", "customer", "nation")

    def known(table: str, key: str, *more: str) -> DataFrame:
        # One row a key, so that a repeated key cannot multiply the lines.
        return t[table].groupBy(key).agg(F.lit(True).alias(f"has_{table}"), *[F.min(c).alias(c) for c in more])

    lines = (t["lineitem"].select("l_orderkey", "l_partkey")
             .join(known("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
             .join(known("part", "p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
             .join(known("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
             .join(known("nation", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    missing = {name: F.col(f"has_{name}").isNull() for name in ("orders", "part", "customer", "nation")}
    left_out = missing["orders"] | missing["part"] | missing["customer"] | missing["nation"]
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(missing["orders"]).alias("without_order"),
                     F.count_if(missing["part"]).alias("without_part"),
                     F.count_if(~missing["orders"] & missing["customer"]).alias("without_customer"),
                     F.count_if(~missing["customer"] & missing["nation"]).alias("without_nation"),
                     F.count_if(left_out).alias("left_out"))


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table that lines are joined to: its rows, its distinct keys, and
    the keys that stand more than once (a many-to-one join needs none)."""
    tables = load_tables(spark, sf_dir, *KEYS)
    out = None
    for table, key in KEYS.items():
        one = (tables[table].groupBy(key).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("right_rows"),
                    F.count(key).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
               .select(F.lit(table).alias("right_table"), "*"))
        out = one if out is None else out.unionByName(one)
    return out

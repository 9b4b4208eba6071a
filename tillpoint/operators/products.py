"""Product and market mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, money, safe_div


def top_products(lines: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` stock codes by revenue (ties: stock code).

    The (stock, invoice) pre-aggregate combines map-side and makes ``orders``
    a plain count; the top-n is a per-partition TakeOrderedAndProject.
    """
    si = (lines.groupBy("stock_code", "invoice_no")
          .agg(F.max("description").alias("d"), F.sum("quantity").alias("q"),
               F.sum("revenue_cents").alias("rc")))
    p = si.groupBy("stock_code").agg(
        F.max("d").alias("one_recorded_description"), F.count(F.lit(1)).alias("orders"),
        F.sum("q").cast("bigint").alias("units"), F.sum("rc").alias("rc"))
    return (p.orderBy(F.desc("rc"), F.asc("stock_code")).limit(n)
            .select("stock_code", "one_recorded_description", "orders", "units",
                    money("rc").alias("observed_revenue")))


def _modal(counts: DataFrame) -> DataFrame:
    """Most frequent description per stock code of (stock_code, description, n);
    ties take the smallest, and NULL only stands where there is no other."""
    rank = F.struct(F.col("description").isNull().alias("none"), (-F.col("n")).alias("n"), F.col("description").alias("d"))
    return counts.groupBy("stock_code").agg(F.min_by("description", rank).alias("description"))


def product_modal_description(lines: DataFrame, empty: str = "") -> DataFrame:
    """Most frequent description per stock code; ties take the smallest.
    Descriptions are counted as rows, not in a map held for each code."""
    counts = lines.groupBy("stock_code", "description").agg(F.count(F.lit(1)).alias("n"))
    return _modal(counts).select("stock_code", F.coalesce("description", F.lit(empty)).alias("description"))


def product_summary(lines: DataFrame) -> DataFrame:
    """Totals and modal description of every stock code, from one scan of the
    lines: their (stock, invoice, description) counts are rolled up to invoices
    and to descriptions by grouping sets, and both meet again by stock code."""
    sid = (lines.groupBy("stock_code", "invoice_no", "description")
           .agg(F.sum("quantity").alias("q"), F.sum("revenue_cents").alias("rc"), F.count(F.lit(1)).alias("n")))
    sets = (sid.groupingSets([["stock_code", "invoice_no"], ["stock_code", "description"]],
                             "stock_code", "invoice_no", "description")
            .agg((F.grouping("description") == 1).alias("of_invoice"), F.sum("q").alias("q"), F.sum("rc").alias("rc"),
                 F.sum("n").alias("n")))
    # Most frequent first, then the smallest; NULL only where there is no other.
    rank = F.struct(F.col("description").isNull().alias("none"), (-F.col("n")).alias("n"), F.col("description").alias("d"))

    def over_invoices(c: str) -> Column:
        return F.sum(F.when(F.col("of_invoice"), F.col(c)))

    p = sets.groupBy("stock_code").agg(
        over_invoices("rc").alias("rc"), over_invoices("q").cast("bigint").alias("units"), over_invoices("n").alias("line_items"),
        F.count_if("of_invoice").alias("orders"), F.min(F.when(~F.col("of_invoice"), rank)).alias("modal"))
    return p.select("stock_code", money("rc").alias("revenue"), "units", "line_items", "orders",
                    F.coalesce("modal.d", F.lit("")).alias("description"))


def top_products_named(lines: DataFrame, n: int = 6) -> DataFrame:
    """Top ``n`` stock codes by revenue with units and modal description: the
    codes first, then the names of those ``n`` alone."""
    top = (lines.groupBy("stock_code").agg(F.sum("revenue_cents").alias("rc"), F.sum("quantity").cast("bigint").alias("units"))
           .orderBy(F.desc("rc"), F.asc("stock_code")).limit(n))
    few = F.broadcast(top.select("stock_code"))  # at most n rows
    names = product_modal_description(lines.join(few, "stock_code", "left_semi"))
    return top.join(names, "stock_code").select("stock_code", "description", "units", money("rc").alias("revenue"))


def _country_totals(invoices_df: DataFrame) -> DataFrame:
    return invoices_df.groupBy("country").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_id").alias("customers"),
        F.sum("revenue_cents").alias("rc"))


def country_share(invoices_df: DataFrame) -> DataFrame:
    c = _country_totals(invoices_df)
    everything = Window.partitionBy(F.lit(1))  # one row per country
    return c.select("country", "orders", "customers", money("rc").alias("observed_revenue"),
                    dround(F.lit(100.0) * safe_div("rc", F.sum("rc").over(everything)), 2)
                    .alias("share_of_extract_pct"))


def home_country(invoices_df: DataFrame) -> DataFrame:
    """One row: the top-revenue country (the home market)."""
    c = invoices_df.groupBy("country").agg(F.sum("revenue_cents").alias("rc"))
    return c.orderBy(F.desc("rc"), F.asc("country")).limit(1).select(F.col("country").alias("home_country"))


def is_home(home: DataFrame) -> Column:
    """True where the country is the home market (a scalar subquery over
    the one-row ``home``); false for a NULL country, as an anti join."""
    return F.coalesce(F.col("country") == home.select("home_country").scalar(), F.lit(False))


def non_home_market_mix(invoices_df: DataFrame, n: int = 7) -> DataFrame:
    """Share of sales outside the home market, top ``n`` countries."""
    c = invoices_df.groupBy("country").agg(F.sum("revenue_cents").alias("rc"))
    rest = c.where(~is_home(home_country(invoices_df)))
    everything = Window.partitionBy(F.lit(1))
    return (rest.select("country", money("rc").alias("observed_revenue"),
                        dround(F.lit(100.0) * safe_div("rc", F.sum("rc").over(everything)), 2)
                        .alias("non_home_share_pct"), "rc")
            .orderBy(F.desc("rc"), F.asc("country")).limit(n).drop("rc"))

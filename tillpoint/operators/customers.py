"""Customer analytics: cohorts, RFM segments, frequency bands, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import (dround, frequency_band, frequency_band_key, money,
                                         month_index, month_label, safe_div)
from tillpoint.functions.ordering import sequential_key

SHARE_LABELS = {"customer_share_pct": "Share of customers",
                "revenue_share_pct": "Share of recorded sales"}


def cohort_retention(invoices_df: DataFrame) -> DataFrame:
    """Month-specific (not cumulative) retention per first-observed cohort.

    One shuffle on customer: ``collect_set`` of active months combines
    map-side, so even a customer with a third of all invoices contributes
    at most one entry per calendar month.  The remaining steps run on
    (cohort, month index) rows, bounded by the calendar.
    """
    per_customer = invoices_df.groupBy("customer_id").agg(
        F.array_sort(F.collect_set("month")).alias("months"))
    activity = per_customer.select(F.col("months")[0].alias("cohort_month"),
                                   F.explode("months").alias("activity_month"))
    counts = (activity.withColumn("month_index", month_index("activity_month", "cohort_month"))
              .groupBy("cohort_month", "month_index")
              .agg(F.count(F.lit(1)).alias("returning_customers")))
    cohort = Window.partitionBy("cohort_month")
    size = F.max(F.when(F.col("month_index") == 0, F.col("returning_customers"))).over(cohort)
    return counts.select(
        "cohort_month", F.col("month_index").cast("bigint").alias("month_index"),
        size.alias("cohort_size"), "returning_customers",
        dround(F.lit(100.0) * safe_div("returning_customers", size), 2).alias("retention_pct"))


def cohort_matrix(retention: DataFrame, max_index: int = 4) -> DataFrame:
    """Wide matrix, month index 0..max_index; missing cells stay NULL."""
    idx = list(range(max_index + 1))
    wide = (retention.groupBy("cohort_month", "cohort_size")
            .pivot("month_index", idx).agg(F.first("retention_pct")))
    return wide.select("cohort_month", "cohort_size",
                       *[F.col(str(i)).alias(f"month_{i}") for i in idx])


def cohort_next_month(retention: DataFrame) -> DataFrame:
    return (retention.where(F.col("month_index") == 1)
            .select(F.col("cohort_month"),
                    F.col("cohort_size").alias("customers_in_cohort"),
                    F.col("returning_customers").alias("customers_next_month"),
                    F.col("retention_pct").alias("next_month_retention_pct")))


def rfm_segments(customers_df: DataFrame) -> DataFrame:
    """Segment totals and averages, with revenue share of the extract."""
    seg = customers_df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("revenue_cents").alias("rc"),
        F.avg("orders").alias("avg_orders"),
        F.avg("recency_days").alias("avg_recency"))
    everything = Window.partitionBy(F.lit(1))  # at most six segment rows
    return seg.select(
        "segment", "customers",
        money("rc").alias("observed_revenue"),
        dround("avg_orders", 2).alias("average_invoice_frequency"),
        dround("avg_recency", 2).alias("average_recency_days"),
        dround(F.lit(100.0) * safe_div("rc", F.sum("rc").over(everything)), 2).alias("revenue_share_pct"))


def segment_share_long(customers_df: DataFrame) -> DataFrame:
    """Customer share vs revenue share per segment, unpivoted."""
    seg = customers_df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("revenue_cents").alias("rc"))
    everything = Window.partitionBy(F.lit(1))
    wide = seg.select(
        "segment",
        (F.lit(100.0) * safe_div("n", F.sum("n").over(everything))).alias("customer_share_pct"),
        (F.lit(100.0) * safe_div("rc", F.sum("rc").over(everything))).alias("revenue_share_pct"))
    long = wide.unpivot("segment", list(SHARE_LABELS), "measure", "share")
    label = F.when(F.col("measure") == "customer_share_pct", SHARE_LABELS["customer_share_pct"]) \
             .otherwise(SHARE_LABELS["revenue_share_pct"])
    return long.select("segment", label.alias("measure"), dround("share", 2).alias("share_pct"))


def customer_country(invoices_df: DataFrame) -> DataFrame:
    """Highest-revenue country per customer (ties: alphabetical).

    The window runs over (customer, country) aggregates, so a group holds at
    most one row per country.
    """
    cc = invoices_df.groupBy("customer_id", "country").agg(F.sum("revenue_cents").alias("rc"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("rc"), F.asc("country"))
    return (cc.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("customer_id", "country"))


def surrogate_key(invoices_df: DataFrame) -> DataFrame:
    """(customer_id, customer_key): the distinct customers numbered in id order."""
    return sequential_key(invoices_df.select("customer_id").distinct(), "customer_id", "customer_key")


def customer_metrics(customers_df: DataFrame, invoices_df: DataFrame,
                     with_id: bool = False) -> DataFrame:
    """One anonymised row per customer with a surrogate key 1..n in id order."""
    c = customers_df.join(customer_country(invoices_df), "customer_id")
    c = sequential_key(c, "customer_id", "customer_key")
    cols = [F.col("customer_key"), money("revenue_cents").alias("revenue"), F.col("orders"),
            month_label("first_observed_month").alias("first_observed_month"),
            F.col("recency_days"), F.col("country"), F.col("segment")]
    if with_id:
        cols.insert(1, F.col("customer_id"))
    return c.select(*cols)


def multi_country_customers(invoices_df: DataFrame) -> DataFrame:
    per = invoices_df.groupBy("customer_id").agg(
        (F.min("country") != F.max("country")).alias("multi"))
    return per.agg(F.count_if(F.col("multi")).cast("bigint").alias("customers_multiple_countries"))


def frequency_bands(invoices_df: DataFrame) -> DataFrame:
    per = invoices_df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"),
                                                 F.sum("revenue_cents").alias("rc"))
    banded = per.select(frequency_band("orders").alias("frequency_band"),
                        frequency_band_key("orders").alias("sort_key"), "rc")
    return (banded.groupBy("frequency_band", "sort_key")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("rc").alias("rc"))
            .select("frequency_band", "customers", money("rc").alias("revenue")))


def repeat_customer_share(customers_df: DataFrame) -> DataFrame:
    rep = F.col("orders") >= 2
    agg = customers_df.agg(
        F.count_if(rep).cast("bigint").alias("repeat_customers"),
        F.sum(F.when(rep, F.col("revenue_cents")).otherwise(0)).alias("rep_rc"),
        F.count_if(F.col("orders") == 1).cast("bigint").alias("single_invoice_customers"),
        F.count(F.lit(1)).alias("customers"),
        F.sum("revenue_cents").alias("rc"))
    return agg.select(
        "repeat_customers", money("rep_rc").alias("repeat_customer_revenue"),
        "single_invoice_customers",
        dround(F.lit(100.0) * safe_div("repeat_customers", "customers"), 2).alias("repeat_customer_share_pct"),
        dround(F.lit(100.0) * safe_div("rep_rc", "rc"), 2).alias("repeat_revenue_share_pct"))

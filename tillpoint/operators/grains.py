"""Invoice, invoice-status and customer grains.

Most marts read the invoice grain, which is one row per invoice and an
order of magnitude smaller than the lines.  It is built by one aggregation
that combines map-side (a hot invoice shrinks to one row per task before
the exchange) and is staged once per input (``plans.context``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import customer_status, month_start, segment_expr


def invoice_full(lines: DataFrame) -> DataFrame:
    """Invoice grain plus every per-invoice check, in one aggregation.

    Carries the ``invoices`` columns, so the grains and marts can read it,
    and the line-level counts as sums, so no headline part needs the lines
    again (except the distinct product count).
    """
    same = (F.dayofmonth("parsed_ts") == F.month("parsed_ts")) & (F.dayofmonth("parsed_ts") <= 12)
    return (lines.groupBy("invoice_no").agg(
        F.min("customer_id").alias("customer_id"),
        F.min("country").alias("country"),
        F.min("invoice_date").alias("invoice_date"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("quantity").cast("bigint").alias("items"),
        F.max("invoice_date").alias("last_ts"),
        F.min("parsed_ts").alias("first_raw_ts"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("was_swapped").alias("n_swapped"),
        F.count_if(same).alias("n_same_day_month"),
        (F.min("customer_id") != F.max("customer_id")).alias("multi_customer"),
        (F.min("country") != F.max("country")).alias("multi_country"))
        .withColumn("month", month_start("invoice_date")))


INVOICE_COLUMNS = ("invoice_no", "customer_id", "country", "invoice_date", "revenue_cents", "items", "month")


def invoices(lines: DataFrame) -> DataFrame:
    """(invoice_no, customer_id, country, invoice_date, revenue_cents, items, month).

    Customer and country are functionally dependent on the invoice (checked
    by ``quality.functional_dependency``), so ``min`` picks the one value.
    The invoice date is the earliest repaired timestamp.  Catalyst prunes
    the check columns of ``invoice_full`` that are not selected.
    """
    return invoice_full(lines).select(*INVOICE_COLUMNS)


def first_seen(invoices_df: DataFrame) -> DataFrame:
    """First observed month per customer (partial aggregation, skew-safe)."""
    return invoices_df.groupBy("customer_id").agg(F.min("month").alias("first_observed_month"))


def invoice_status(invoices_df: DataFrame) -> DataFrame:
    """Invoice grain + first observed month + status.

    An aggregate joined back (rather than a window over the customer) keeps
    a customer with a third of all invoices from landing in one task: the
    aggregate combines map-side and AQE splits a skewed join partition.
    """
    return (invoices_df.join(first_seen(invoices_df), "customer_id")
            .withColumn("status", customer_status("month", "first_observed_month")))


def as_of_date(lines: DataFrame) -> DataFrame:
    """One row: the day after the last repaired timestamp."""
    return lines.agg(F.date_add(F.to_date(F.max("invoice_date")), 1).alias("as_of"))


def customers(invoices_df: DataFrame, lines: DataFrame) -> DataFrame:
    """Customer grain: revenue, orders, first/last purchase, recency, segment."""
    cust = (invoices_df.groupBy("customer_id")
            .agg(F.sum("revenue_cents").alias("revenue_cents"),
                 F.count(F.lit(1)).alias("orders"),
                 F.min("invoice_date").alias("first_purchase"),
                 F.max("invoice_date").alias("last_purchase"),
                 F.min("month").alias("first_observed_month")))
    # The as-of date is an uncorrelated scalar subquery: evaluated once,
    # then a constant in the projection (no join with the customers).
    as_of = as_of_date(lines).select("as_of").scalar()
    return (cust.withColumn("recency_days",
                            F.datediff(as_of, F.to_date("last_purchase")).cast("bigint"))
            .withColumn("segment", segment_expr("recency_days", "orders")))

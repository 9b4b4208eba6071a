"""Monthly revenue marts: growth decomposition, returning revenue, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import (STATUS_FIRST, STATUS_RETURNING, dround, label_number, money,
                                         month_label, plain_label, relabelled, safe_div)


def _global(order_col: str) -> Window:
    # Unpartitioned window: only ever applied to per-month aggregates,
    # whose row count is bounded by the calendar, never to lines.
    return Window.orderBy(order_col)


def revenue_decomposition(lines: DataFrame) -> DataFrame:
    """Line-level month: revenue, orders, customers, AOV and growth.

    Orders and customers are distinct non-NULL ids among the month's lines.
    Each is counted on its own (month, id) grain, which combines map-side, so
    neither a distinct aggregate nor an Expand meets the lines; the two
    results have one row a month.
    """
    by_invoice = (lines.groupBy("invoice_month", "invoice_no").agg(F.sum("revenue_cents").alias("rc"))
                  .groupBy(F.col("invoice_month").alias("month"))
                  .agg(F.sum("rc").alias("rc"), F.count("invoice_no").alias("orders")))
    by_customer = (lines.select(F.col("invoice_month").alias("month"), "customer_id").distinct()
                   .groupBy("month").agg(F.count("customer_id").alias("active_customers")))
    m = by_invoice.join(by_customer, by_invoice["month"].eqNullSafe(by_customer["month"])).drop(by_customer["month"])
    w = _global("month")
    rev = money("rc")
    return m.select(
        "month",
        dround(rev, 2).alias("revenue"),
        "orders",
        "active_customers",
        dround(safe_div(rev, "orders"), 2).alias("average_order_value"),
        dround(F.lit(100.0) * (safe_div(rev, F.lag(rev).over(w)) - 1), 1).alias("revenue_growth_pct"),
        dround(F.lit(100.0) * (safe_div("orders", F.lag("orders").over(w)) - 1), 1).alias("order_growth_pct"),
    )


def _monthly(invoices_df: DataFrame) -> DataFrame:
    return (invoices_df.groupBy("month")
            .agg(F.sum("revenue_cents").alias("rc"), F.count(F.lit(1)).alias("orders"),
                 F.countDistinct("customer_id").alias("active_customers"),
                 F.sum("items").alias("units")))


def monthly_summary(invoices_df: DataFrame) -> DataFrame:
    """Invoice-level month mart; both observed endpoint months are incomplete."""
    m = _monthly(invoices_df)
    everything = Window.partitionBy(F.lit(1))  # per-month rows only
    rev = money("rc")
    return m.select(
        month_label("month").alias("month"),
        rev.alias("revenue"),
        "orders", "active_customers", "units",
        dround(safe_div(rev, "orders"), 2).alias("aov"),
        F.year("month").cast("bigint").alias("year"),
        ((F.col("month") != F.min("month").over(everything))
         & (F.col("month") != F.max("month").over(everything))).alias("complete_month"),
    )


def focus_months(invoices_df: DataFrame) -> DataFrame:
    """One row: last complete month and the month two before it."""
    return invoices_df.agg(F.add_months(F.max("month"), -1).alias("to_month"),
                           F.add_months(F.max("month"), -3).alias("from_month"))


def period_comparison(invoices_df: DataFrame, metrics=("revenue", "orders", "aov")) -> DataFrame:
    """Change in revenue / orders / AOV between the two focus months, long form."""
    fm = focus_months(invoices_df)
    from_m, to_m = fm.select("from_month").scalar(), fm.select("to_month").scalar()
    m = _monthly(invoices_df).select((F.col("month") == from_m).alias("is_from"),
                                     (F.col("month") == to_m).alias("is_to"), "rc", "orders")
    pick = lambda c, flag: F.sum(F.when(F.col(flag), c))
    agg = m.agg(
        money(pick(F.col("rc"), "is_from")).alias("from_revenue"),
        money(pick(F.col("rc"), "is_to")).alias("to_revenue"),
        pick(F.col("orders"), "is_from").cast("double").alias("from_orders"),
        pick(F.col("orders"), "is_to").cast("double").alias("to_orders")).select(
        from_m.alias("from_month"), to_m.alias("to_month"), "*")
    agg = (agg.withColumn("from_aov", safe_div("from_revenue", "from_orders"))
              .withColumn("to_aov", safe_div("to_revenue", "to_orders")))
    stack = ", ".join(f"'{k}', from_{k}, to_{k}" for k in metrics)
    long = agg.selectExpr("from_month", "to_month",
                          f"stack({len(metrics)}, {stack}) as (metric, from_value, to_value)")
    return long.select(
        month_label("from_month").alias("from_month"), month_label("to_month").alias("to_month"),
        "metric", dround("from_value", 2).alias("from_value"), dround("to_value", 2).alias("to_value"),
        dround(F.lit(100.0) * (safe_div("to_value", "from_value") - 1), 2).alias("change_pct"))


def returning_revenue(status_df: DataFrame) -> DataFrame:
    """Revenue from customers in their first observed month vs later months."""
    first = F.col("month") == F.col("first_observed_month")
    later = F.col("month") > F.col("first_observed_month")
    m = status_df.groupBy("month").agg(
        F.sum(F.when(first, F.col("revenue_cents"))).alias("first_rc"),
        F.sum(F.when(later, F.col("revenue_cents"))).alias("later_rc"),
        F.sum("revenue_cents").alias("rc"),
        F.countDistinct("customer_id").alias("active_customers"))
    return m.select(
        "month",
        money("first_rc").alias("first_observed_month_revenue"),
        money("later_rc").alias("later_month_returning_revenue"),
        dround(F.lit(100.0) * safe_div("later_rc", "rc"), 1).alias("later_month_returning_share_pct"),
        "active_customers")


def status_by_month(status_df: DataFrame) -> DataFrame:
    return (status_df.groupBy("month", "status")
            .agg(F.sum("revenue_cents").alias("rc"), F.count(F.lit(1)).alias("orders"))
            .select(month_label("month").alias("month"), "status",
                    money("rc").alias("revenue"), "orders"))


def monthly_country(status_df: DataFrame) -> DataFrame:
    """Month x country mart with the status pivot (both columns, zero-filled).

    The pivot on status is written as two conditional sums in the same
    aggregate: one pass, and both columns exist even when a status is absent.
    """
    is_first = F.col("status") == STATUS_FIRST
    is_later = F.col("status") == STATUS_RETURNING
    m = (status_df.groupBy("month", "country")
         .agg(F.sum("revenue_cents").alias("rc"), F.count(F.lit(1)).alias("orders"),
              F.countDistinct("customer_id").alias("active_customers"),
              F.sum("items").alias("units"),
              F.sum(F.when(is_first, F.col("revenue_cents")).otherwise(0)).alias("first_rc"),
              F.sum(F.when(is_later, F.col("revenue_cents")).otherwise(0)).alias("later_rc")))
    rev = money("rc")
    return m.select(
        month_label("month").alias("month"), "country",
        rev.alias("revenue"), "orders", "active_customers", "units",
        F.year("month").cast("bigint").alias("year"),
        money("first_rc").alias("first_observed_month_revenue"),
        money("later_rc").alias("returning_later_month_revenue"),
        dround(safe_div(rev, "orders"), 2).alias("aov"))


def months_between(monthly: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """The months from ``first`` to ``last``, both included; labels ``yyyy-MM``
    sort as the months do."""
    return monthly.where(F.col("month").between(first, last))


def months_in(monthly: DataFrame, months: list) -> DataFrame:
    """The months whose labels are listed."""
    return monthly.where(F.col("month").isin(*months))


def focus_labels(invoices_df: DataFrame) -> tuple[Column, Column]:
    """The labels of the two focus months, as scalar subqueries."""
    fm = focus_months(invoices_df)
    return tuple(fm.select(month_label(c).alias("m")).scalar() for c in ("from_month", "to_month"))


def labelled_months(monthly: DataFrame) -> DataFrame:
    """Months taken apart by their labels."""
    return monthly.select("month", label_number("month", 1, 4).alias("year"), label_number("month", -2, 2).alias("month_number"),
                          relabelled(F.col("complete_month").cast("string"), {"true": "complete_month", "false": "partial_month"})
                          .alias("status"),
                          plain_label(relabelled(F.col("complete_month").cast("string"), {
                              "true": "complete_month", "false": "partial_month"})).alias("status_label"))

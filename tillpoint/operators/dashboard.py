"""Dashboard queries: market x period filter, focus comparison, top-n panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, money, safe_div
from tillpoint.operators.products import is_home

PERIODS = ("all", "complete", "focus")


def _month_axis(invoices_df: DataFrame, period: str) -> DataFrame:
    """Months shown for a period: every observed month ("all"), the months
    of the final year up to the last complete month ("complete"), or the
    three focus months ("focus").  The axis is a dense month sequence so
    months without sales appear with zeros."""
    b = invoices_df.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    last_complete = F.add_months(F.col("hi"), -1)
    if period == "all":
        rng = b.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    elif period == "complete":
        rng = b.select(F.trunc(last_complete, "year").alias("a"), last_complete.alias("b"))
    elif period == "focus":
        rng = b.select(F.add_months(F.col("hi"), -3).alias("a"), last_complete.alias("b"))
    else:
        raise ValueError(f"unknown period {period!r}")
    return rng.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))


def market_period(status_df: DataFrame, invoices_df: DataFrame, home: DataFrame,
                  market: str = "all", period: str = "all") -> DataFrame:
    """Zero-filled months: sales, orders and later-month buyer sales."""
    inv = status_df
    if market == "outside_home":
        inv = inv.where(~is_home(home))
    elif market != "all":
        inv = inv.where(F.col("country") == market)
    later = F.col("month") > F.col("first_observed_month")
    m = inv.groupBy("month").agg(F.sum("revenue_cents").alias("rc"), F.count(F.lit(1)).alias("orders"),
                                 F.sum(F.when(later, F.col("revenue_cents")).otherwise(0)).alias("later_rc"))
    axis = F.broadcast(_month_axis(invoices_df, period))  # bounded by the calendar
    return (axis.join(m, "month", "left")
            .select(F.date_format("month", "yyyy-MM").alias("month"),
                    money(F.coalesce("rc", F.lit(0))).alias("sales"),
                    F.coalesce("orders", F.lit(0)).alias("orders"),
                    money(F.coalesce("later_rc", F.lit(0))).alias("later_month_sales")))


def market_kpis(months: DataFrame) -> DataFrame:
    """KPIs as ratios of sums over the shown months."""
    return months.agg(
        dround(F.sum("sales"), 2).alias("sales"),
        F.sum("orders").cast("bigint").alias("orders"),
        dround(safe_div(F.sum("sales"), F.sum("orders")), 2).alias("average_order_value"),
        dround(F.lit(100.0) * safe_div(F.sum("later_month_sales"), F.sum("sales")), 1).alias("later_month_share_pct"))


def top_markets(country_share: DataFrame, n: int = 7) -> DataFrame:
    return (country_share.orderBy(F.desc("observed_revenue"), F.asc("country")).limit(n)
            .select("country", "observed_revenue", "share_of_extract_pct"))


def segments_by_share(segments: DataFrame) -> DataFrame:
    return segments.select("segment", "revenue_share_pct").orderBy(F.desc("revenue_share_pct"))


def series_panel(weekly: DataFrame, holdout_out: DataFrame, series: str = "All products",
                 last_weeks: int = 19) -> DataFrame:
    """Last ``last_weeks`` weeks of one series with the holdout forecasts."""
    h = (weekly.where(F.col("series") == series)
         .orderBy(F.desc("week_start")).limit(last_weeks)
         .select("week_start", F.col("units").alias("observed_units")))
    f = holdout_out.where(F.col("series") == series).select("week_start", "forecast_units", "baseline_units")
    return h.join(f, "week_start", "left")


def cohort_table(retention: DataFrame, max_index: int = 4) -> DataFrame:
    """Display matrix: months +1..+max_index, gaps shown as 0."""
    idx = list(range(1, max_index + 1))
    wide = (retention.where(F.col("month_index").between(1, max_index))
            .groupBy("cohort_month").pivot("month_index", idx).agg(F.first("retention_pct")))
    cohorts = retention.select("cohort_month").distinct()
    return cohorts.join(wide, "cohort_month", "left").select(
        "cohort_month", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"plus_{i}") for i in idx])

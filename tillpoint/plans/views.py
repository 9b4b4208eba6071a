"""SQL access: the extract, its repaired lines and the invoice grain as views,
and the standing analyses as ``spark.sql`` text over them.

``register_views(spark, sf_dir)`` gives a session ``retail_raw_extract``,
``retail_lines`` and ``retail_invoices`` for queries of one's own.  They are
views on the staged tables: dates are not parsed again, and a query's filters
and columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.columns import (BAND_1, BAND_2_4, BAND_5_9, BAND_10, SEG_AT_RISK, SEG_CHAMPIONS,
                                         SEG_DEVELOPING, SEG_DORMANT, SEG_LOYAL, SEG_RECENT)
from tillpoint.plans.context import Ctx
from tillpoint.sources import staging

VIEWS = ("raw_extract", "lines", "invoices")


def view_frames(c: Ctx) -> dict[str, DataFrame]:
    """The views by name; money is DECIMAL, as in the extract."""
    revenue = (F.col("revenue_cents").cast("decimal(38,0)") / 100).cast("decimal(38,2)")
    return {
        "raw_extract": c.raw,
        "lines": c.lines.select("invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id", "country",
                                "invoice_date_text", "parsed_ts", "invoice_date", "invoice_month", "revenue"),
        "invoices": c.invoices.select("invoice_no", "customer_id", "country", "invoice_date", "month",
                                      revenue.alias("revenue"), "items"),
    }


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "retail_") -> list[str]:
    """Create or replace the session's views for one input; their names."""
    frames = view_frames(Ctx(spark, sf_dir))
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]


def drop_views(spark: SparkSession, prefix: str = "retail_") -> None:
    for name in VIEWS:
        spark.catalog.dropTempView(prefix + name)


def run(c: Ctx, text: str) -> DataFrame:
    """A query over the views of ``c``'s input, named ``{lines}`` and so on.
    Each input has views of its own, so queries on two inputs do not meet."""
    prefix = f"retail_{staging.fingerprint(c.spark, c.sf_dir)}_"
    names = register_views(c.spark, c.sf_dir, prefix)
    return c.spark.sql(text.format(**dict(zip(VIEWS, names))))


def _rounded(value: str, digits: int) -> str:
    """Half-up from the decimal image of a double, as a double."""
    return f"double(round(cast({value} AS DECIMAL(38,10)), {digits}))"


def _growth(value: str) -> str:
    before = f"lag({value}) OVER (ORDER BY month)"
    return _rounded(f"100 * (double({value}) / nullif(double({before}), 0) - 1)", 1)


ANALYSES = {
    # More orders, or larger ones?
    "sql_revenue_decomposition": f"""
        SELECT month, {_rounded('revenue', 2)} AS revenue, orders, active_customers,
               {_rounded('double(revenue) / nullif(orders, 0)', 2)} AS average_order_value,
               {_growth('revenue')} AS revenue_growth_pct, {_growth('orders')} AS order_growth_pct
        FROM (SELECT invoice_month AS month, sum(revenue) AS revenue, count(DISTINCT invoice_no) AS orders,
                     count(DISTINCT customer_id) AS active_customers
              FROM {{lines}} GROUP BY invoice_month)""",
    # Sales to customers in the month they are first seen, and after it.
    "sql_returning_revenue": f"""
        WITH seen AS (SELECT customer_id AS who, min(month) AS first_month FROM {{invoices}} GROUP BY customer_id),
             sales AS (SELECT month, revenue, customer_id, month > first_month AS returning
                       FROM {{invoices}} JOIN seen ON customer_id = who)
        SELECT month, double(sum(revenue) FILTER (WHERE NOT returning)) AS first_observed_month_revenue,
               double(sum(revenue) FILTER (WHERE returning)) AS later_month_returning_revenue,
               {_rounded('100 * double(sum(revenue) FILTER (WHERE returning)) / nullif(double(sum(revenue)), 0)', 1)}
                 AS later_month_returning_share_pct,
               count(DISTINCT customer_id) AS active_customers
        FROM sales GROUP BY month""",
    # Who came back in which month, by the month first seen.
    "sql_cohort_retention": f"""
        WITH visits AS (SELECT array_sort(collect_set(month)) AS months FROM {{invoices}} GROUP BY customer_id),
             moved AS (SELECT months[0] AS cohort_month, explode(months) AS month FROM visits),
             counted AS (SELECT cohort_month,
                                bigint(12 * (year(month) - year(cohort_month)) + month(month) - month(cohort_month)) AS month_index,
                                count(*) AS returning_customers
                         FROM moved GROUP BY ALL)
        SELECT cohort_month, month_index, cohort_size, returning_customers,
               {_rounded('100 * double(returning_customers) / nullif(cohort_size, 0)', 2)} AS retention_pct
        FROM (SELECT *, max(if(month_index = 0, returning_customers, NULL)) OVER (PARTITION BY cohort_month) AS cohort_size
              FROM counted)""",
    # Segments by recency and frequency on the day after the last line.
    "sql_rfm_segments": f"""
        WITH customers AS (
               SELECT customer_id, sum(revenue) AS revenue, count(*) AS orders,
                      datediff((SELECT date_add(max(invoice_date), 1) FROM {{lines}}), max(invoice_date)) AS days
               FROM {{invoices}} GROUP BY customer_id),
             labelled AS (
               SELECT revenue, orders, days,
                      CASE WHEN days <= 30 AND orders >= 5 THEN '{SEG_CHAMPIONS}'
                           WHEN days <= 90 AND orders >= 5 THEN '{SEG_LOYAL}'
                           WHEN days > 90 THEN if(orders >= 3, '{SEG_AT_RISK}', '{SEG_DORMANT}')
                           WHEN days <= 30 THEN '{SEG_RECENT}' ELSE '{SEG_DEVELOPING}' END AS segment
               FROM customers)
        SELECT segment, count(*) AS customers, double(sum(revenue)) AS observed_revenue,
               {_rounded('avg(orders)', 2)} AS average_invoice_frequency, {_rounded('avg(days)', 2)} AS average_recency_days,
               {_rounded('100 * double(sum(revenue)) / nullif(double(sum(sum(revenue)) OVER ()), 0)', 2)} AS revenue_share_pct
        FROM labelled GROUP BY segment""",
    "sql_top_products": """
        SELECT stock_code, max(description) AS one_recorded_description, count(DISTINCT invoice_no) AS orders,
               sum(quantity) AS units, double(sum(revenue)) AS observed_revenue
        FROM {lines} GROUP BY stock_code ORDER BY sum(revenue) DESC, stock_code LIMIT 15""",
    "sql_country_share": f"""
        SELECT country, count(*) AS orders, count(DISTINCT customer_id) AS customers, double(sum(revenue)) AS observed_revenue,
               {_rounded('100 * double(sum(revenue)) / nullif(double(sum(sum(revenue)) OVER ()), 0)', 2)} AS share_of_extract_pct
        FROM {{invoices}} GROUP BY country""",
    "sql_repair_summary": """
        SELECT count(*) AS rows, count_if(invoice_date <> parsed_ts) AS repaired_dates,
               count_if(day(parsed_ts) = month(parsed_ts)) AS same_day_month_rows,
               count(DISTINCT invoice_no) AS distinct_invoices, count(DISTINCT customer_id) AS distinct_customers
        FROM {lines}""",
    # Rows that repeat in every column, and what they are worth.
    "sql_duplicate_sensitivity": """
        SELECT bigint(sum(n - 1)) AS possible_duplicate_rows,
               double(sum((n - 1) * value) FILTER (WHERE n > 1)) AS sensitivity_value,
               double(sum(value)) AS revenue_if_duplicates_dropped
        FROM (SELECT count(*) AS n, any_value(quantity * unit_price) AS value FROM {raw_extract}
              GROUP BY invoice_no, stock_code, description, quantity, unit_price, customer_id, country, invoice_date_text,
                       original_year, original_month, original_week, original_day, original_weekday)""",
    "sql_multi_timestamp_invoices": """
        SELECT invoice_no, size(collect_set(invoice_date)) AS distinct_timestamps
        FROM {lines} GROUP BY invoice_no HAVING min(invoice_date) < max(invoice_date)""",
    "sql_frequency_bands": f"""
        WITH customers AS (SELECT count(*) AS orders, sum(revenue) AS revenue FROM {{invoices}} GROUP BY customer_id)
        SELECT CASE WHEN orders >= 10 THEN '{BAND_10[0]}' WHEN orders >= 5 THEN '{BAND_5_9[0]}'
                    WHEN orders >= 2 THEN '{BAND_2_4[0]}' ELSE '{BAND_1[0]}' END AS frequency_band,
               count(*) AS customers, double(sum(revenue)) AS revenue
        FROM customers GROUP BY frequency_band""",
}

QUERIES = {name: lambda c, text=text: run(c, text) for name, text in ANALYSES.items()}
# The DataFrame query that each analysis equals.
EQUALS = {name: {"sql_repair_summary": "dq_repair_summary", "sql_duplicate_sensitivity": "dq_duplicate_sensitivity",
                 "sql_multi_timestamp_invoices": "dq_multi_timestamp_invoices"}.get(name, name.removeprefix("sql_"))
          for name in ANALYSES}

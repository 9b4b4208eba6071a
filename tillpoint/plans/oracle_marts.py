"""Oracle SQL for the BI measures over the SQL-derivable marts."""

from __future__ import annotations

from tillpoint.plans import oracle_forecasting  # noqa: F401  (its CTEs are used here)
from tillpoint.plans.oracle_analytics import SQL as A
from tillpoint.plans.oracle_base import D, M, MLABEL, R, cte, with_ctes

cte("sales_mart", f"""
  SELECT {MLABEL('month')} AS month, country, {M('rc')} AS revenue, orders, active_customers, units,
         {M('first_rc')} AS first_observed_month_revenue, {M('later_rc')} AS returning_later_month_revenue
  FROM (SELECT month, country, sum(revenue_cents) AS rc, count(*) AS orders,
               count(DISTINCT customer_id) AS active_customers, CAST(sum(items) AS BIGINT) AS units,
               sum(CASE WHEN status = 'First observed month' THEN revenue_cents ELSE 0 END) AS first_rc,
               sum(CASE WHEN status = 'Returning (later month)' THEN revenue_cents ELSE 0 END) AS later_rc
        FROM status GROUP BY month, country) t""")

cte("customers_mart", """
  SELECT CAST(c.revenue_cents AS DOUBLE) / 100.0 AS revenue, c.orders, c.recency_days, cc.country, c.segment
  FROM customers c JOIN (
    SELECT customer_id, country FROM (
      SELECT customer_id, country,
             row_number() OVER (PARTITION BY customer_id ORDER BY rc DESC, country ASC) AS rn
      FROM (SELECT customer_id, country, sum(revenue_cents) AS rc FROM invoices GROUP BY customer_id, country) a) b
    WHERE rn = 1) cc USING (customer_id)""")

cte("cohort_month1", """
  SELECT cohort_month, cohort_size AS customers_in_cohort, returning_customers AS customers_next_month
  FROM cohorts WHERE month_index = 1""")

cte("forecast_all", f"""
  SELECT w.week_start, w.units AS observed_units, h.forecast_units, h.baseline_units,
         CASE WHEN h.forecast_units IS NOT NULL THEN 'Yes' ELSE 'No' END AS is_holdout
  FROM weekly_top w LEFT JOIN (
    SELECT week_start, {R('forecast', 1)} AS forecast_units, {R('baseline', 1)} AS baseline_units
    FROM holdout WHERE series = 'All products') h USING (week_start)
  WHERE w.is_all""")

cte("forecast_sku_errors", f"""
  SELECT series, {R("CASE WHEN CAST(sum(abs(actual_units)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual_units - forecast)) / CAST(sum(abs(actual_units)) AS DOUBLE) END", 2)} AS holdout_wape
  FROM holdout WHERE series <> 'All products' GROUP BY series""")

cte("ml_scores_stat", """
  SELECT s.method, s.validation_wape, h.holdout_wape FROM scores s JOIN (
    SELECT method, CASE WHEN CAST(sum(abs(actual)) AS DOUBLE) <> 0
                        THEN 100.0 * sum(abs(actual - forecast)) / CAST(sum(abs(actual)) AS DOUBLE) END AS holdout_wape
    FROM fca_top WHERE kind = 'test' AND series = 'All products' GROUP BY method) h USING (method)
  WHERE s.series = 'All products'""")

cte("ml_holdout_stat", """
  SELECT week_start, CAST(first(actual) AS DOUBLE) AS actual_units,
         max(CASE WHEN method = 'four_week_mean' THEN forecast END) AS mean_forecast,
         max(CASE WHEN method = 'eight_week_damped_trend' THEN forecast END) AS damped_forecast
  FROM fca_top WHERE kind = 'test' AND series = 'All products' GROUP BY week_start""")

YES = "is_holdout = 'Yes'"
MEASURE_SQL = {
    "recorded_sales": ("sales_mart", "sum(revenue)"),
    "invoices": ("sales_mart", "sum(orders)"),
    "average_order_value": ("sales_mart", D("sum(revenue)", "sum(orders)")),
    "later_month_buyer_sales": ("sales_mart", "sum(returning_later_month_revenue)"),
    "later_month_buyer_share": ("sales_mart", D("sum(returning_later_month_revenue)", "sum(revenue)")),
    "customer_count": ("customers_mart", "count(*)"),
    "multiple_order_buyers": ("customers_mart", "count(*) FILTER (WHERE orders >= 2)"),
    "multi_order_buyer_sales_share": ("customers_mart", D("sum(CASE WHEN orders >= 2 THEN revenue END)", "sum(revenue)")),
    "champion_sales_share": ("customers_mart", D("sum(CASE WHEN segment = 'Champions' THEN revenue END)", "sum(revenue)")),
    "customer_sales": ("customers_mart", "sum(revenue)"),
    "next_month_cohort_retention": ("cohort_month1", D("sum(customers_next_month)", "sum(customers_in_cohort)")),
    "weekly_observed_units": ("forecast_all", "sum(observed_units)"),
    "weekly_selected_forecast": ("forecast_all", "sum(forecast_units)"),
    "weekly_baseline_forecast": ("forecast_all", "sum(baseline_units)"),
    "actual_holdout_units": ("forecast_all", f"sum(CASE WHEN {YES} THEN observed_units END)"),
    "selected_holdout_forecast": ("forecast_all", "sum(forecast_units)"),
    "selected_holdout_wape": ("forecast_all", D(f"sum(CASE WHEN {YES} THEN abs(observed_units - forecast_units) END)",
                                                f"sum(CASE WHEN {YES} THEN observed_units END)")),
    "simple_holdout_wape": ("forecast_all", D(f"sum(CASE WHEN {YES} THEN abs(observed_units - baseline_units) END)",
                                              f"sum(CASE WHEN {YES} THEN observed_units END)")),
    "selected_sku_wape": ("forecast_sku_errors", "sum(holdout_wape)"),
    "damped_holdout_wape": ("ml_scores_stat",
                            "avg(CASE WHEN method = 'eight_week_damped_trend' THEN holdout_wape END) / 100.0"),
    "baseline_holdout_wape": ("ml_scores_stat", "avg(CASE WHEN method = 'four_week_mean' THEN holdout_wape END) / 100.0"),
    "ml_actual_units": ("ml_holdout_stat", "sum(actual_units)"),
    "ml_damped_forecast": ("ml_holdout_stat", "sum(damped_forecast)"),
    "ml_moving_average": ("ml_holdout_stat", "sum(mean_forecast)"),
}


# Totals of money to the cent, the rest to six places.
_MONEY = ("recorded_sales", "later_month_buyer_sales", "customer_sales")


def _m(name: str, expr: str | None = None) -> str:
    return f"{R(f'CAST({expr or MEASURE_SQL[name][1]} AS DOUBLE)', 2 if name in _MONEY else 6)} AS {name}"


SQL: dict[str, str] = {}
for _name, (_mart, _expr) in MEASURE_SQL.items():
    SQL[f"m_{_name}"] = with_ctes(f"SELECT {_m(_name)} FROM {_mart}")


def _grouped(mart: str, names: list[str], by: list[str]) -> str:
    return with_ctes(f"SELECT {', '.join(by)}, {', '.join(_m(n) for n in names)} FROM {mart} GROUP BY {', '.join(by)}")


SQL["bi_sales_by_month_country"] = _grouped(
    "sales_mart", ["recorded_sales", "invoices", "average_order_value", "later_month_buyer_share"], ["month", "country"])
SQL["bi_customers_by_segment"] = _grouped(
    "customers_mart", ["customer_count", "customer_sales", "multiple_order_buyers", "multi_order_buyer_sales_share",
                       "champion_sales_share"], ["segment"])
SQL["bi_cohort_next_month"] = _grouped("cohort_month1", ["next_month_cohort_retention"], ["cohort_month"])
SQL["bi_forecast_weekly"] = _grouped(
    "forecast_all", ["weekly_observed_units", "weekly_selected_forecast", "weekly_baseline_forecast"], ["week_start"])

SQL["m_recorded_sales_sliced"] = with_ctes(f"SELECT {_m('recorded_sales')} FROM sales_mart WHERE country = 'FRANCE'")
# KEEPFILTERS: the measure's own condition and the slicer both hold.
SQL["m_multiple_order_buyers_sliced"] = with_ctes(
    f"SELECT {_m('multiple_order_buyers', 'count(*) FILTER (WHERE orders >= 2 AND orders <= 3)')} FROM customers_mart")
# CALCULATE replaces the slicer of the same column; FILTER iterates what the slicer leaves.
SQL["m_actual_holdout_units_sliced"] = with_ctes(f"SELECT {_m('actual_holdout_units')} FROM forecast_all")
SQL["m_selected_holdout_wape_sliced"] = with_ctes(f"""SELECT {_m('selected_holdout_wape', D(
    f"sum(CASE WHEN {YES} AND is_holdout = 'No' THEN abs(observed_units - forecast_units) END)",
    f"sum(CASE WHEN {YES} THEN observed_units END)"))} FROM forecast_all""")

SQL["mart_sales"] = A["monthly_country"]
SQL["mart_customers"] = A["customer_metrics"]
SQL["mart_cohort_month1"] = A["cohort_next_month"]
SQL["mart_forecast_all"] = with_ctes(
    "SELECT week_start, observed_units, forecast_units, baseline_units, is_holdout FROM forecast_all")
SQL["mart_forecast_sku_errors"] = with_ctes(f"""
SELECT * FROM (
SELECT series, product, method AS selected_method,
       {R("CASE WHEN CAST(sum(abs(actual_units)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual_units - forecast)) / CAST(sum(abs(actual_units)) AS DOUBLE) END", 2)} AS holdout_wape,
       {R("CASE WHEN CAST(sum(abs(actual_units)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual_units - baseline)) / CAST(sum(abs(actual_units)) AS DOUBLE) END", 2)} AS baseline_holdout_wape,
       CAST(sum(actual_units) AS BIGINT) AS actual_total, {R('sum(forecast)', 1)} AS forecast_total,
       {R('sum(baseline)', 1)} AS baseline_forecast_total
FROM holdout GROUP BY series, product, method) t WHERE series <> 'All products'""")

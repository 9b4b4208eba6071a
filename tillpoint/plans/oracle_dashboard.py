"""Oracle SQL for the dashboard queries."""

from __future__ import annotations

from tillpoint.plans import oracle_forecasting  # noqa: F401  (its CTEs are used here)
from tillpoint.plans.oracle_analytics import SQL as A
from tillpoint.plans.oracle_base import D, M, R, with_ctes

SQL: dict[str, str] = {}

_RANGES = {
    "all": ("lo", "hi"),
    "complete": ("date_trunc('year', hi - INTERVAL 1 MONTH)", "hi - INTERVAL 1 MONTH"),
    "focus": ("hi - INTERVAL 3 MONTH", "hi - INTERVAL 1 MONTH"),
}
_MARKETS = {"all": "TRUE", "outside_home": "country NOT IN (SELECT home_country FROM home)", "france": "country = 'FRANCE'"}


def _months(market: str, period: str) -> str:
    first, last = _RANGES[period]
    return f"""
  SELECT strftime(a.month, '%Y-%m') AS month, {M('coalesce(m.rc, 0)')} AS sales,
         coalesce(m.orders, 0) AS orders, {M('coalesce(m.later_rc, 0)')} AS later_month_sales
  FROM (SELECT CAST(unnest(generate_series(CAST({first} AS TIMESTAMP), CAST({last} AS TIMESTAMP),
                                           INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT min(month) AS lo, max(month) AS hi FROM invoices) b) a LEFT JOIN (
    SELECT month, sum(revenue_cents) AS rc, count(*) AS orders,
           sum(CASE WHEN month > first_observed_month THEN revenue_cents ELSE 0 END) AS later_rc
    FROM status WHERE {_MARKETS[market]} GROUP BY month) m USING (month)"""


SQL["dash_market_period"] = with_ctes(f"SELECT * FROM ({_months('all', 'all')}) t")
for _market in _MARKETS:
    for _period in _RANGES:
        SQL[f"dash_market_period_{_market}_{_period}"] = with_ctes(f"SELECT * FROM ({_months(_market, _period)}) t")
SQL["dash_market_kpis"] = with_ctes(f"""
SELECT {R('sum(sales)', 2)} AS sales, CAST(sum(orders) AS BIGINT) AS orders,
       {R(D('sum(sales)', 'sum(orders)'), 2)} AS average_order_value,
       {R(f"100.0 * {D('sum(later_month_sales)', 'sum(sales)')}", 1)} AS later_month_share_pct
FROM ({_months('all', 'all')}) t""")
SQL["dash_focus_compare"] = A["period_comparison"] + " WHERE metric IN ('orders', 'aov')"
SQL["dash_top_markets"] = with_ctes(f"""
SELECT country, {M('sum(revenue_cents)')} AS observed_revenue,
       {R(f"100.0 * {D('sum(revenue_cents)', 'sum(sum(revenue_cents)) OVER ()')}", 2)} AS share_of_extract_pct
FROM invoices GROUP BY country ORDER BY sum(revenue_cents) DESC, country LIMIT 7""")
SQL["dash_top_products"] = with_ctes(f"""
SELECT p.stock_code, coalesce(m.description, '') AS description, p.units, {M('p.rc')} AS revenue
FROM (SELECT stock_code, sum(revenue_cents) AS rc, CAST(sum(quantity) AS BIGINT) AS units
      FROM lines GROUP BY stock_code) p
LEFT JOIN (SELECT stock_code, description FROM (
             SELECT stock_code, description,
                    row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description ASC) AS rn
             FROM (SELECT stock_code, description, count(*) AS n FROM lines
                   WHERE description IS NOT NULL GROUP BY stock_code, description) a) b WHERE rn = 1) m
  USING (stock_code)
ORDER BY p.rc DESC, p.stock_code LIMIT 6""")
SQL["dash_segments"] = with_ctes(f"""
SELECT segment, {R(f"100.0 * {D('rc', 'sum(rc) OVER ()')}", 2)} AS revenue_share_pct FROM segments""")
SQL["dash_series_panel"] = with_ctes(f"""
SELECT w.week_start, w.observed_units, h.forecast_units, h.baseline_units
FROM (SELECT week_start, units AS observed_units FROM weekly_top WHERE series = 'All products'
      ORDER BY week_start DESC LIMIT 19) w
LEFT JOIN (SELECT week_start, {R('forecast', 1)} AS forecast_units, {R('baseline', 1)} AS baseline_units
           FROM holdout WHERE series = 'All products') h USING (week_start)""")
SQL["dash_cohort_table"] = with_ctes("""
SELECT cohort_month,
       coalesce(max(CASE WHEN month_index = 1 THEN retention_pct END), 0.0) AS plus_1,
       coalesce(max(CASE WHEN month_index = 2 THEN retention_pct END), 0.0) AS plus_2,
       coalesce(max(CASE WHEN month_index = 3 THEN retention_pct END), 0.0) AS plus_3,
       coalesce(max(CASE WHEN month_index = 4 THEN retention_pct END), 0.0) AS plus_4
FROM cohorts GROUP BY cohort_month""")

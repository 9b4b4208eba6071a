"""Independent DuckDB SQL for the oracle check: CTE library + helpers.

Written directly from the query semantics (not generated from the Spark
plans), over the pre-registered test tables.
"""

from __future__ import annotations

import re


def M(x: str) -> str:
    """Integer cents -> currency double."""
    return f"(CAST({x} AS DOUBLE) / 100.0)"


def R(x: str, n: int) -> str:
    """Half-up rounding on a decimal image, returned as double."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def D(a: str, b: str) -> str:
    """a / NULLIF(b, 0) in double arithmetic."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def SWAP(t: str) -> str:
    return (f"CASE WHEN day({t}) <= 12 AND month({t}) <= 12 AND day({t}) <> month({t}) "
            f"THEN make_timestamp(year({t}), day({t}), month({t}), hour({t}), minute({t}), "
            f"CAST(second({t}) AS DOUBLE)) ELSE {t} END")


def MLABEL(d: str) -> str:
    return f"strftime({d}, '%Y-%m')"


# The rules and their labels.
SEGMENT = """CASE
   WHEN recency_days <= 30 AND orders >= 5 THEN 'Champions'
   WHEN recency_days <= 90 AND orders >= 5 THEN 'Loyal active'
   WHEN recency_days > 90 AND orders >= 3 THEN 'At risk (rule-based)'
   WHEN recency_days > 90 THEN 'Dormant (rule-based)'
   WHEN recency_days <= 30 THEN 'Recent buyers'
   ELSE 'Developing' END"""

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


cte("raw", f"""
  SELECT o.o_orderkey AS invoice_no,
         CAST(p.p_partkey AS VARCHAR) AS stock_code,
         p.p_brand || '/' || p.p_type AS product_line,
         p.p_name AS description,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(14,2)) AS unit_price,
         o.o_custkey AS customer_id,
         n.n_name AS country,
         strftime(o.raw_ts, '%Y-%m-%d %H:%M:%S') AS invoice_date_text,
         CAST(year(o.raw_ts) AS INTEGER) AS original_year,
         CAST(month(o.raw_ts) AS INTEGER) AS original_month,
         CAST(weekofyear(o.raw_ts) AS INTEGER) AS original_week,
         CAST(day(o.raw_ts) AS INTEGER) AS original_day,
         CAST(isodow(o.raw_ts) - 1 AS INTEGER) AS original_weekday
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN (SELECT o_orderkey, o_custkey, {SWAP('o_orderdate')} AS raw_ts FROM orders) o
    ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("lines", f"""
  SELECT b.*,
         CAST(date_trunc('month', invoice_date) AS DATE) AS invoice_month,
         CAST(quantity * unit_price AS DECIMAL(18,2)) AS revenue,
         CAST(quantity AS BIGINT) * CAST(unit_price * 100 AS BIGINT) AS revenue_cents,
         CAST(date_trunc('week', invoice_date) AS DATE) AS week_start,
         invoice_date <> parsed_ts AS was_swapped
  FROM (SELECT a.*, {SWAP('parsed_ts')} AS invoice_date
        FROM (SELECT r.*, strptime(invoice_date_text, '%Y-%m-%d %H:%M:%S') AS parsed_ts FROM raw r) a) b""")

cte("series_lines", "SELECT * REPLACE (product_line AS stock_code) FROM lines")

cte("invoices", """
  SELECT invoice_no, min(customer_id) AS customer_id, min(country) AS country,
         min(invoice_date) AS invoice_date,
         CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
         CAST(sum(quantity) AS BIGINT) AS items,
         CAST(date_trunc('month', min(invoice_date)) AS DATE) AS month
  FROM lines GROUP BY invoice_no""")

cte("first_seen", """
  SELECT customer_id, min(month) AS first_observed_month FROM invoices GROUP BY customer_id""")

cte("status", """
  SELECT i.*, f.first_observed_month,
         CASE WHEN i.month = f.first_observed_month THEN 'First observed month'
              ELSE 'Returning (later month)' END AS status
  FROM invoices i JOIN first_seen f USING (customer_id)""")

cte("asof_day", """
  SELECT CAST(max(invoice_date) AS DATE) + 1 AS as_of FROM lines""")

cte("customers", f"""
  SELECT x.*, {SEGMENT} AS segment FROM (
    SELECT c.*, CAST(date_diff('day', CAST(c.last_purchase AS DATE), a.as_of) AS BIGINT) AS recency_days
    FROM (SELECT customer_id, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
                 count(*) AS orders, min(invoice_date) AS first_purchase,
                 max(invoice_date) AS last_purchase, min(month) AS first_observed_month
          FROM invoices GROUP BY customer_id) c CROSS JOIN asof_day a) x""")

cte("monthly", """
  SELECT month, CAST(sum(revenue_cents) AS BIGINT) AS rc, count(*) AS orders,
         count(DISTINCT customer_id) AS active_customers, CAST(sum(items) AS BIGINT) AS units
  FROM invoices GROUP BY month""")

cte("focus", """
  SELECT CAST(max(month) - INTERVAL 1 MONTH AS DATE) AS to_month,
         CAST(max(month) - INTERVAL 3 MONTH AS DATE) AS from_month FROM invoices""")

cte("cohort_base", """
  SELECT cohort_month, month_index, count(*) AS returning_customers FROM (
    SELECT a.customer_id, a.month AS activity_month, f.first_observed_month AS cohort_month,
           CAST((year(a.month) - year(f.first_observed_month)) * 12
                + month(a.month) - month(f.first_observed_month) AS BIGINT) AS month_index
    FROM (SELECT DISTINCT customer_id, month FROM invoices) a JOIN first_seen f USING (customer_id)) t
  GROUP BY cohort_month, month_index""")

cte("cohorts", f"""
  SELECT b.cohort_month, b.month_index, s.cohort_size, b.returning_customers,
         {R(f"100.0 * {D('b.returning_customers', 's.cohort_size')}", 2)} AS retention_pct
  FROM cohort_base b JOIN (SELECT cohort_month, returning_customers AS cohort_size
                           FROM cohort_base WHERE month_index = 0) s USING (cohort_month)""")

cte("country_rev", """
  SELECT country, CAST(sum(revenue_cents) AS BIGINT) AS rc FROM invoices GROUP BY country""")

cte("home", """
  SELECT country AS home_country FROM country_rev ORDER BY rc DESC, country ASC LIMIT 1""")

cte("invoice_checks", """
  SELECT invoice_no, min(parsed_ts) AS first_raw_ts, min(invoice_date) AS first_ts,
         min(invoice_date) <> max(invoice_date) AS multi_ts,
         min(customer_id) <> max(customer_id) AS multi_customer,
         min(country) <> max(country) AS multi_country
  FROM lines GROUP BY invoice_no""")

cte("dup_groups", """
  SELECT count(*) AS n, CAST(sum(CAST(quantity AS BIGINT) * CAST(unit_price * 100 AS BIGINT)) AS BIGINT) AS rc,
         min(CAST(quantity AS BIGINT) * CAST(unit_price * 100 AS BIGINT)) AS one
  FROM raw GROUP BY invoice_no, stock_code, description, quantity, unit_price, customer_id, country,
                    invoice_date_text, original_year, original_month, original_week, original_day,
                    original_weekday""")

cte("segments", f"""
  SELECT segment, count(*) AS customers, CAST(sum(revenue_cents) AS BIGINT) AS rc,
         avg(orders) AS avg_orders, avg(recency_days) AS avg_recency
  FROM customers GROUP BY segment""")


def _deps(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def with_ctes(final: str) -> str:
    """Prefix ``final`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(CTES[name]):
            if d != name:
                visit(d)
        order.append(name)

    for n in _deps(final):
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + final

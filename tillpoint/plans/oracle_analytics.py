"""Oracle SQL for the analytic and data-quality queries."""

from __future__ import annotations

from tillpoint.plans.oracle_base import D, M, MLABEL, R, with_ctes

_share_window = "OVER ()"

SQL: dict[str, str] = {}


def q(name: str, final: str) -> None:
    SQL[name] = with_ctes(final)


q("lines_repaired", """
SELECT invoice_no, stock_code, description, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       customer_id, country, invoice_date_text, parsed_ts, invoice_date, invoice_month,
       CAST(revenue AS DOUBLE) AS revenue
FROM lines""")

q("invoices", f"""
SELECT invoice_no, customer_id, country, invoice_date, month, {M('revenue_cents')} AS revenue, items
FROM invoices""")

q("invoice_status", f"""
SELECT invoice_no, customer_id, country, invoice_date, month, {M('revenue_cents')} AS revenue, items,
       first_observed_month, status
FROM status""")

q("revenue_decomposition", f"""
SELECT month, {R(M('rc'), 2)} AS revenue, orders, active_customers,
       {R(D(M('rc'), 'orders'), 2)} AS average_order_value,
       {R(f"100.0 * ({D(M('rc'), 'LAG(' + M('rc') + ') OVER (ORDER BY month)')} - 1)", 1)} AS revenue_growth_pct,
       {R(f"100.0 * ({D('orders', 'LAG(orders) OVER (ORDER BY month)')} - 1)", 1)} AS order_growth_pct
FROM (SELECT invoice_month AS month, CAST(sum(revenue_cents) AS BIGINT) AS rc, count(DISTINCT invoice_no) AS orders,
             count(DISTINCT customer_id) AS active_customers
      FROM lines GROUP BY invoice_month) m""")

q("monthly_summary", f"""
SELECT {MLABEL('month')} AS month, {M('rc')} AS revenue, orders, active_customers, units,
       {R(D(M('rc'), 'orders'), 2)} AS aov, CAST(year(month) AS BIGINT) AS year,
       (month <> min(month) OVER () AND month <> max(month) OVER ()) AS complete_month
FROM monthly""")

_MONTHS = f"""
SELECT {MLABEL('month')} AS month, {M('rc')} AS revenue, orders, active_customers, units,
       {R(D(M('rc'), 'orders'), 2)} AS aov, CAST(year(month) AS BIGINT) AS year,
       (month <> min(month) OVER () AND month <> max(month) OVER ()) AS complete_month
FROM monthly"""

q("focus_range", f"""
SELECT t.* FROM ({_MONTHS}) t
WHERE t.month BETWEEN (SELECT {MLABEL('from_month')} FROM focus) AND (SELECT {MLABEL('to_month')} FROM focus)""")

q("focus_months_listed", f"""
SELECT t.* FROM ({_MONTHS}) t
WHERE t.month IN ((SELECT {MLABEL('from_month')} FROM focus), (SELECT {MLABEL('to_month')} FROM focus))""")

q("labelled_months", f"""
SELECT t.month, CAST(t.month[1:4] AS INTEGER) AS year, CAST(t.month[6:7] AS INTEGER) AS month_number,
       CASE WHEN t.complete_month THEN 'complete_month' ELSE 'partial_month' END AS status,
       CASE WHEN t.complete_month THEN 'complete month' ELSE 'partial month' END AS status_label
FROM ({_MONTHS}) t""")

q("period_comparison", f"""
SELECT {MLABEL('from_month')} AS from_month, {MLABEL('to_month')} AS to_month, metric,
       {R('from_value', 2)} AS from_value, {R('to_value', 2)} AS to_value,
       {R(f"100.0 * ({D('to_value', 'from_value')} - 1)", 2)} AS change_pct
FROM (
  SELECT from_month, to_month, 'revenue' AS metric, from_revenue AS from_value, to_revenue AS to_value, 1 AS k FROM agg
  UNION ALL SELECT from_month, to_month, 'orders', from_orders, to_orders, 2 FROM agg
  UNION ALL SELECT from_month, to_month, 'aov', {D('from_revenue', 'from_orders')}, {D('to_revenue', 'to_orders')}, 3 FROM agg
) u""".replace("FROM agg", f"""FROM (
  SELECT f.from_month, f.to_month,
         {M('sum(CASE WHEN m.month = f.from_month THEN m.rc END)')} AS from_revenue,
         {M('sum(CASE WHEN m.month = f.to_month THEN m.rc END)')} AS to_revenue,
         CAST(sum(CASE WHEN m.month = f.from_month THEN m.orders END) AS DOUBLE) AS from_orders,
         CAST(sum(CASE WHEN m.month = f.to_month THEN m.orders END) AS DOUBLE) AS to_orders
  FROM monthly m CROSS JOIN focus f GROUP BY f.from_month, f.to_month) agg"""))

q("returning_revenue", f"""
SELECT month,
       {M('sum(revenue_cents) FILTER (WHERE month = first_observed_month)')} AS first_observed_month_revenue,
       {M('sum(revenue_cents) FILTER (WHERE month > first_observed_month)')} AS later_month_returning_revenue,
       {R(f"100.0 * {D('sum(revenue_cents) FILTER (WHERE month > first_observed_month)', 'sum(revenue_cents)')}", 1)}
         AS later_month_returning_share_pct,
       count(DISTINCT customer_id) AS active_customers
FROM status GROUP BY month""")

q("status_by_month", f"""
SELECT {MLABEL('month')} AS month, status, {M('sum(revenue_cents)')} AS revenue, count(*) AS orders
FROM status GROUP BY month, status""")

q("monthly_country", f"""
SELECT {MLABEL('month')} AS month, country, {M('rc')} AS revenue, orders, active_customers, units,
       CAST(year(month) AS BIGINT) AS year,
       {M('first_rc')} AS first_observed_month_revenue, {M('later_rc')} AS returning_later_month_revenue,
       {R(D(M('rc'), 'orders'), 2)} AS aov
FROM (SELECT month, country, sum(revenue_cents) AS rc, count(*) AS orders,
             count(DISTINCT customer_id) AS active_customers, CAST(sum(items) AS BIGINT) AS units,
             sum(CASE WHEN status = 'First observed month' THEN revenue_cents ELSE 0 END) AS first_rc,
             sum(CASE WHEN status = 'Returning (later month)' THEN revenue_cents ELSE 0 END) AS later_rc
      FROM status GROUP BY month, country) t""")

q("cohort_retention", """
SELECT cohort_month, month_index, cohort_size, returning_customers, retention_pct FROM cohorts""")

q("cohort_matrix", """
SELECT cohort_month, cohort_size,
       max(CASE WHEN month_index = 0 THEN retention_pct END) AS month_0,
       max(CASE WHEN month_index = 1 THEN retention_pct END) AS month_1,
       max(CASE WHEN month_index = 2 THEN retention_pct END) AS month_2,
       max(CASE WHEN month_index = 3 THEN retention_pct END) AS month_3,
       max(CASE WHEN month_index = 4 THEN retention_pct END) AS month_4
FROM cohorts GROUP BY cohort_month, cohort_size""")

q("cohort_next_month", """
SELECT cohort_month, cohort_size AS customers_in_cohort, returning_customers AS customers_next_month,
       retention_pct AS next_month_retention_pct
FROM cohorts WHERE month_index = 1""")

q("rfm_segments", f"""
SELECT segment, customers, {M('rc')} AS observed_revenue,
       {R('avg_orders', 2)} AS average_invoice_frequency, {R('avg_recency', 2)} AS average_recency_days,
       {R(f"100.0 * {D('rc', 'sum(rc) OVER ()')}", 2)} AS revenue_share_pct
FROM segments""")

q("segment_share_long", f"""
SELECT segment, 'Share of customers' AS measure, {R(f"100.0 * {D('customers', 'sum(customers) OVER ()')}", 2)} AS share_pct
FROM segments
UNION ALL
SELECT segment, 'Share of recorded sales', {R(f"100.0 * {D('rc', 'sum(rc) OVER ()')}", 2)}
FROM segments""")

_cust_country = """
  SELECT customer_id, country FROM (
    SELECT customer_id, country, row_number() OVER (PARTITION BY customer_id ORDER BY rc DESC, country ASC) AS rn
    FROM (SELECT customer_id, country, sum(revenue_cents) AS rc FROM invoices GROUP BY customer_id, country) a) b
  WHERE rn = 1"""

q("customer_metrics", f"""
SELECT row_number() OVER (ORDER BY c.customer_id) AS customer_key, {M('c.revenue_cents')} AS revenue,
       c.orders, {MLABEL('c.first_observed_month')} AS first_observed_month, c.recency_days,
       cc.country, c.segment
FROM customers c JOIN ({_cust_country}) cc USING (customer_id)""")

q("customer_surrogate_key", """
SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS customer_key FROM customers""")

q("multi_country_customers", """
SELECT count(*) FILTER (WHERE multi) AS customers_multiple_countries
FROM (SELECT customer_id, min(country) <> max(country) AS multi FROM invoices GROUP BY customer_id) t""")

q("frequency_bands", f"""
SELECT frequency_band, count(*) AS customers, {M('sum(rc)')} AS revenue FROM (
  SELECT CASE WHEN orders = 1 THEN '1 order' WHEN orders BETWEEN 2 AND 4 THEN '2-4 orders'
              WHEN orders BETWEEN 5 AND 9 THEN '5-9 orders' ELSE '10+ orders' END AS frequency_band,
         CASE WHEN orders = 1 THEN 1 WHEN orders <= 4 THEN 2 WHEN orders <= 9 THEN 3 ELSE 4 END AS sort_key,
         rc
  FROM (SELECT customer_id, count(*) AS orders, sum(revenue_cents) AS rc FROM invoices GROUP BY customer_id) f) b
GROUP BY frequency_band, sort_key""")

q("repeat_customer_share", f"""
SELECT count(*) FILTER (WHERE orders >= 2) AS repeat_customers,
       {M('sum(CASE WHEN orders >= 2 THEN revenue_cents ELSE 0 END)')} AS repeat_customer_revenue,
       count(*) FILTER (WHERE orders = 1) AS single_invoice_customers,
       {R(f"100.0 * {D('count(*) FILTER (WHERE orders >= 2)', 'count(*)')}", 2)} AS repeat_customer_share_pct,
       {R(f"100.0 * {D('sum(CASE WHEN orders >= 2 THEN revenue_cents ELSE 0 END)', 'sum(revenue_cents)')}", 2)}
         AS repeat_revenue_share_pct
FROM customers""")

q("top_products", f"""
SELECT stock_code, max(description) AS one_recorded_description, count(DISTINCT invoice_no) AS orders,
       CAST(sum(quantity) AS BIGINT) AS units, {M('sum(revenue_cents)')} AS observed_revenue
FROM lines GROUP BY stock_code ORDER BY sum(revenue_cents) DESC, stock_code LIMIT 15""")

_modal = """
  SELECT stock_code, description FROM (
    SELECT stock_code, description,
           row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description ASC) AS rn
    FROM (SELECT stock_code, description, count(*) AS n FROM lines
          WHERE description IS NOT NULL GROUP BY stock_code, description) a) b WHERE rn = 1"""

q("product_modal_description", f"""
SELECT s.stock_code, coalesce(m.description, '') AS description
FROM (SELECT DISTINCT stock_code FROM lines) s LEFT JOIN ({_modal}) m USING (stock_code)""")

q("product_summary", f"""
SELECT p.stock_code, {M('p.rc')} AS revenue, p.units, p.line_items, p.orders,
       coalesce(m.description, '') AS description
FROM (SELECT stock_code, sum(revenue_cents) AS rc, CAST(sum(quantity) AS BIGINT) AS units,
             count(*) AS line_items, count(DISTINCT invoice_no) AS orders
      FROM lines GROUP BY stock_code) p LEFT JOIN ({_modal}) m USING (stock_code)""")

q("country_share", f"""
SELECT country, count(*) AS orders, count(DISTINCT customer_id) AS customers,
       {M('sum(revenue_cents)')} AS observed_revenue,
       {R(f"100.0 * {D('sum(revenue_cents)', 'sum(sum(revenue_cents)) OVER ()')}", 2)} AS share_of_extract_pct
FROM invoices GROUP BY country""")

q("non_home_market_mix", f"""
SELECT country, {M('rc')} AS observed_revenue,
       {R(f"100.0 * {D('rc', 'sum(rc) OVER ()')}", 2)} AS non_home_share_pct
FROM country_rev WHERE country NOT IN (SELECT home_country FROM home)
ORDER BY rc DESC, country LIMIT 7""")

q("dq_not_null", """
SELECT count(*) FILTER (WHERE invoice_no IS NULL) AS null_invoice_no,
       count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_id FROM raw""")

q("dq_positive", """
SELECT count(*) FILTER (WHERE quantity <= 0) AS non_positive_quantity,
       count(*) FILTER (WHERE unit_price <= 0) AS non_positive_price FROM raw""")

q("dq_non_empty", """
SELECT count(*) > 0 AS non_empty FROM (SELECT 1 FROM raw LIMIT 1) t""")

q("dq_functional_dependency", """
SELECT count(*) FILTER (WHERE multi_customer) AS invoices_multi_customer,
       count(*) FILTER (WHERE multi_country) AS invoices_multi_country FROM invoice_checks""")

q("dq_date_bounds", """
SELECT min(invoice_date) AS date_min, max(invoice_date) AS date_max FROM lines""")

q("dq_repair_summary", """
SELECT count(*) AS rows, count(*) FILTER (WHERE invoice_date <> parsed_ts) AS repaired_dates,
       count(*) FILTER (WHERE day(parsed_ts) = month(parsed_ts) AND day(parsed_ts) <= 12) AS same_day_month_rows,
       count(DISTINCT invoice_no) AS distinct_invoices, count(DISTINCT customer_id) AS distinct_customers
FROM lines""")

q("dq_duplicate_sensitivity", f"""
SELECT CAST(sum(n - 1) AS BIGINT) AS possible_duplicate_rows,
       {M('sum(CASE WHEN n > 1 THEN (n - 1) * one END)')} AS sensitivity_value,
       {M('sum(rc) - coalesce(sum(CASE WHEN n > 1 THEN (n - 1) * one END), 0)')} AS revenue_if_duplicates_dropped
FROM dup_groups""")

q("dq_multi_timestamp_invoices", """
SELECT invoice_no, count(DISTINCT invoice_date) AS distinct_timestamps
FROM lines GROUP BY invoice_no HAVING count(DISTINCT invoice_date) > 1""")

_inversions = """
  SELECT CAST(count(*) FILTER (WHERE first_raw_ts < prev_raw) AS BIGINT) AS inversions_raw,
         CAST(count(*) FILTER (WHERE first_ts < prev_ts) AS BIGINT) AS inversions_corrected
  FROM (SELECT first_raw_ts, first_ts,
               lag(first_raw_ts) OVER (ORDER BY invoice_no) AS prev_raw,
               lag(first_ts) OVER (ORDER BY invoice_no) AS prev_ts
        FROM invoice_checks) t"""

q("dq_chronology_inversions", _inversions)

q("dq_reconcile", f"""
SELECT check_name, detail_total, summary_total, round(detail_total - summary_total, 6) AS difference FROM (
 SELECT check_name, {R('detail_total', 2)} AS detail_total, {R('summary_total', 2)} AS summary_total FROM (
  SELECT 'monthly_revenue_vs_total' AS check_name,
         (SELECT sum({M('rc')}) FROM monthly) AS detail_total,
         (SELECT {M('sum(revenue_cents)')} FROM lines) AS summary_total
  UNION ALL
  SELECT 'country_orders_vs_monthly_orders',
         (SELECT CAST(count(*) AS DOUBLE) FROM invoices),
         (SELECT CAST(sum(orders) AS DOUBLE) FROM monthly)
  UNION ALL
  SELECT 'segment_revenue_vs_total',
         (SELECT sum({M('rc')}) FROM segments),
         (SELECT {M('sum(revenue_cents)')} FROM lines)
  UNION ALL
  SELECT 'status_revenue_vs_country_pivot',
         (SELECT sum(r) FROM (SELECT {M('sum(revenue_cents)')} AS r FROM status GROUP BY month, status) a),
         (SELECT sum(r) FROM (SELECT {M("sum(CASE WHEN status = 'First observed month' THEN revenue_cents ELSE 0 END)")}
                                   + {M("sum(CASE WHEN status = 'Returning (later month)' THEN revenue_cents ELSE 0 END)")} AS r
                              FROM status GROUP BY month, country) b)
  UNION ALL
  SELECT 'cohort_sizes_vs_customers',
         (SELECT CAST(sum(cohort_size) AS DOUBLE) FROM cohorts WHERE month_index = 0),
         (SELECT CAST(count(*) AS DOUBLE) FROM customers)
) t0) t""")

q("assert_many_to_one", " UNION ALL ".join(f"""
SELECT '{table}' AS right_table, count(*) AS right_rows, count(DISTINCT {key}) AS distinct_keys,
       (SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1) r) AS repeated_keys
FROM {table}""" for table, key in (("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"),
                                   ("nation", "n_nationkey"))))

q("dq_required_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS required_column, TRUE AS present, count({c}) AS values FROM raw"
    for c in ("invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id", "country",
              "invoice_date_text")))

q("dq_violations", """
SELECT count(*) AS rows, count(*) FILTER (WHERE invoice_date_text IS NULL) AS null_invoice_date,
       count(*) FILTER (WHERE invoice_no IS NULL) AS null_invoice_no,
       count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_id,
       count(*) FILTER (WHERE quantity <= 0) AS non_positive_quantity,
       count(*) FILTER (WHERE unit_price <= 0) AS non_positive_price,
       (SELECT count(*) FROM invoice_checks WHERE multi_customer) AS invoices_multi_customer,
       (SELECT count(*) FROM invoice_checks WHERE multi_country) AS invoices_multi_country
FROM raw""")

q("dq_orphan_lines", """
SELECT count(*) AS lines,
       count(*) FILTER (WHERE o_orderkey IS NULL) AS without_order,
       count(*) FILTER (WHERE p_partkey IS NULL) AS without_part,
       count(*) FILTER (WHERE o_orderkey IS NOT NULL AND c_custkey IS NULL) AS without_customer,
       count(*) FILTER (WHERE c_custkey IS NOT NULL AND n_nationkey IS NULL) AS without_nation,
       count(*) FILTER (WHERE o_orderkey IS NULL OR p_partkey IS NULL OR c_custkey IS NULL OR n_nationkey IS NULL)
         AS left_out
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")

_RAW_COLUMNS = ("invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id", "country",
                "invoice_date_text", "original_year", "original_month", "original_week", "original_day",
                "original_weekday")
q("table_fingerprint", f"""
SELECT count(*) AS rows, CAST(sum(nulls) AS BIGINT) AS null_values, bit_xor(h) AS xor_hash,
       CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum_hash
FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', {", ".join(
    f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in _RAW_COLUMNS)})), 1, 15) AS BIGINT) AS h,
             {" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _RAW_COLUMNS)} AS nulls
      FROM raw) t""")

q("headline_metrics", f"""
SELECT l.rows, i.customers, i.invoices, p.products, i.countries, {M('l.rc')} AS revenue,
       {R(D(M('l.rc'), 'i.invoices'), 2)} AS aov,
       l.date_swapped_rows, l.date_same_day_month_rows,
       inv.inversions_raw AS invoice_date_inversions_raw,
       inv.inversions_corrected AS invoice_date_inversions_corrected,
       ch.invoices_with_multiple_corrected_timestamps,
       mc.customer_multiple_country_count,
       dup.duplicate_exact_rows, dup.revenue_if_exact_duplicates_dropped, dup.duplicate_revenue_sensitivity,
       l.date_min, l.date_max,
       rep.repeat_customers_multi_invoice, rep.repeat_customers_multi_invoice_revenue,
       rep.single_invoice_customers, hs.home_country, hs.home_revenue_share_pct,
       fo.focus_from_month, fo.focus_to_month, fo.focus_from_sales, fo.focus_to_sales,
       fo.focus_from_orders, fo.focus_to_orders, fo.focus_from_aov, fo.focus_to_aov,
       l.asof_date
FROM (SELECT count(*) AS rows, CAST(sum(revenue_cents) AS BIGINT) AS rc,
             count(*) FILTER (WHERE was_swapped) AS date_swapped_rows,
             count(*) FILTER (WHERE day(parsed_ts) = month(parsed_ts) AND day(parsed_ts) <= 12) AS date_same_day_month_rows,
             min(invoice_date) AS date_min, max(invoice_date) AS date_max,
             CAST(max(invoice_date) AS DATE) + 1 AS asof_date FROM lines) l
CROSS JOIN (SELECT count(DISTINCT stock_code) AS products FROM lines) p
CROSS JOIN (SELECT count(*) AS invoices, count(DISTINCT customer_id) AS customers,
                   count(DISTINCT country) AS countries FROM invoices) i
CROSS JOIN (SELECT count(*) FILTER (WHERE multi_ts) AS invoices_with_multiple_corrected_timestamps FROM invoice_checks) ch
CROSS JOIN ({_inversions}) inv
CROSS JOIN (SELECT count(*) FILTER (WHERE multi) AS customer_multiple_country_count
            FROM (SELECT customer_id, min(country) <> max(country) AS multi FROM invoices GROUP BY customer_id) x) mc
CROSS JOIN (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_exact_rows,
                   {M('sum(rc) - coalesce(sum(CASE WHEN n > 1 THEN (n - 1) * one END), 0)')} AS revenue_if_exact_duplicates_dropped,
                   coalesce({M('sum(CASE WHEN n > 1 THEN (n - 1) * one END)')}, 0.0) AS duplicate_revenue_sensitivity
            FROM dup_groups) dup
CROSS JOIN (SELECT count(*) FILTER (WHERE orders >= 2) AS repeat_customers_multi_invoice,
                   {M('sum(CASE WHEN orders >= 2 THEN revenue_cents ELSE 0 END)')} AS repeat_customers_multi_invoice_revenue,
                   count(*) FILTER (WHERE orders = 1) AS single_invoice_customers FROM customers) rep
CROSS JOIN (SELECT h.home_country,
                   {R(f"100.0 * {D('sum(CASE WHEN c.country = h.home_country THEN c.rc ELSE 0 END)', 'sum(c.rc)')}", 2)}
                     AS home_revenue_share_pct
            FROM country_rev c CROSS JOIN home h GROUP BY h.home_country) hs
CROSS JOIN (SELECT {MLABEL('f.from_month')} AS focus_from_month, {MLABEL('f.to_month')} AS focus_to_month,
                   {M('sum(CASE WHEN m.month = f.from_month THEN m.rc END)')} AS focus_from_sales,
                   {M('sum(CASE WHEN m.month = f.to_month THEN m.rc END)')} AS focus_to_sales,
                   CAST(coalesce(sum(CASE WHEN m.month = f.from_month THEN m.orders END), 0) AS BIGINT) AS focus_from_orders,
                   CAST(coalesce(sum(CASE WHEN m.month = f.to_month THEN m.orders END), 0) AS BIGINT) AS focus_to_orders,
                   {R(D(M('sum(CASE WHEN m.month = f.from_month THEN m.rc END)'), 'sum(CASE WHEN m.month = f.from_month THEN m.orders END)'), 2)} AS focus_from_aov,
                   {R(D(M('sum(CASE WHEN m.month = f.to_month THEN m.rc END)'), 'sum(CASE WHEN m.month = f.to_month THEN m.orders END)'), 2)} AS focus_to_aov
            FROM monthly m CROSS JOIN focus f GROUP BY f.from_month, f.to_month) fo""")

q("sales_rollup", f"""
SELECT CASE g WHEN 0 THEN 'month and country' WHEN 1 THEN 'month' WHEN 2 THEN 'country' ELSE 'all' END AS level,
       {MLABEL('month')} AS month, country, active_customers, orders, units, {M('rc')} AS revenue,
       {M('first_rc')} AS first_observed_month_revenue, {M('later_rc')} AS returning_later_month_revenue,
       {R(D(M('rc'), 'orders'), 2)} AS aov
FROM (SELECT grouping_id(month, country) AS g, month, country, count(DISTINCT customer_id) AS active_customers,
             count(*) AS orders, CAST(sum(items) AS BIGINT) AS units, sum(revenue_cents) AS rc,
             sum(CASE WHEN status = 'First observed month' THEN revenue_cents ELSE 0 END) AS first_rc,
             sum(CASE WHEN status = 'Returning (later month)' THEN revenue_cents ELSE 0 END) AS later_rc
      FROM status GROUP BY GROUPING SETS ((month, country), (month), (country), ())) t""")

q("quarterly_customers", f"""
SELECT CAST(year(month) AS BIGINT) AS year, CAST(quarter(month) AS BIGINT) AS quarter, country,
       count(DISTINCT customer_id) AS active_customers, count(*) AS orders, {M('sum(revenue_cents)')} AS revenue
FROM invoices GROUP BY year(month), quarter(month), country""")

q("dq_quarantine", """
SELECT count(*) AS rows, count(*) FILTER (WHERE reasons = 0) AS accepted, count(*) FILTER (WHERE reasons > 0) AS refused,
       CAST(sum(reasons) AS BIGINT) AS reasons
FROM (SELECT CAST(invoice_no IS NULL AS INTEGER) + CAST(customer_id IS NULL AS INTEGER)
             + CAST(invoice_date_text IS NULL AS INTEGER)
             + CAST(invoice_date_text IS NOT NULL AND try_strptime(invoice_date_text, '%Y-%m-%d %H:%M:%S') IS NULL AS INTEGER)
             + CAST(coalesce(quantity <= 0, FALSE) AS INTEGER) + CAST(coalesce(unit_price <= 0, FALSE) AS INTEGER) AS reasons
      FROM raw) t""")

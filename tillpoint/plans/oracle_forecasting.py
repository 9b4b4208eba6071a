"""Oracle SQL for the statistical forecasting queries."""

from __future__ import annotations

from tillpoint.plans.oracle_base import R, cte, with_ctes


# The sums of 0.65, 0.65^2, ... over one to four weeks.
DAMPED_STEPS = [0.65, 0.65 + 0.65 ** 2, 0.65 + 0.65 ** 2 + 0.65 ** 3, 0.65 + 0.65 ** 2 + 0.65 ** 3 + 0.65 ** 4]


def LIT(x: float) -> str:
    return f"CAST({repr(float(x))} AS DOUBLE)"


cte("cal", """
  SELECT last_week, last_week - 357 AS first_week, last_week - 21 AS test_origin,
         last_week - 21 - 161 AS v1, last_week - 21 - 133 AS v2, last_week - 21 - 105 AS v3,
         last_week - 21 - 77 AS v4, last_week - 21 - 49 AS v5
  FROM (SELECT CAST(date_trunc('week', CAST(max(invoice_date) AS DATE) + 1) AS DATE) - 7 AS last_week
        FROM lines) x""")

cte("origins", """
  SELECT v1 AS origin, 'validation' AS kind, 1 AS fold FROM cal
  UNION ALL SELECT v2, 'validation', 2 FROM cal
  UNION ALL SELECT v3, 'validation', 3 FROM cal
  UNION ALL SELECT v4, 'validation', 4 FROM cal
  UNION ALL SELECT v5, 'validation', 5 FROM cal
  UNION ALL SELECT test_origin, 'test', 6 FROM cal""")

cte("initial_lines", """
  SELECT l.* FROM series_lines l, cal c WHERE l.week_start >= c.first_week AND l.week_start < c.v1""")

cte("pop", """
  SELECT stock_code, count(DISTINCT invoice_no) AS orders, count(DISTINCT week_start) AS active_weeks
  FROM initial_lines GROUP BY stock_code""")

cte("pool", """
  SELECT stock_code, row_number() OVER (ORDER BY orders DESC, active_weeks DESC, stock_code) AS pool_rank
  FROM pop WHERE active_weeks >= 12 QUALIFY pool_rank <= 120""")

cte("top5", """
  SELECT stock_code, row_number() OVER (ORDER BY orders DESC, active_weeks DESC, stock_code) AS top_rank
  FROM pop WHERE active_weeks >= 17 QUALIFY top_rank <= 5""")

cte("selection", """
  SELECT stock_code, p.orders, p.active_weeks, CAST(coalesce(s.pool_rank, 0) AS BIGINT) AS pool_rank,
         CAST(coalesce(s.top_rank, 0) AS BIGINT) AS top_rank
  FROM (SELECT coalesce(a.stock_code, b.stock_code) AS stock_code, a.pool_rank, b.top_rank
        FROM pool a FULL JOIN top5 b ON a.stock_code = b.stock_code) s JOIN pop p USING (stock_code)""")

cte("weeks", """
  SELECT CAST(unnest(generate_series(CAST(first_week AS TIMESTAMP), CAST(last_week AS TIMESTAMP),
                                     INTERVAL 7 DAY)) AS DATE) AS week_start FROM cal""")

cte("sku_week", """
  SELECT l.stock_code, l.week_start, CAST(sum(l.quantity) AS BIGINT) AS units
  FROM series_lines l, cal c WHERE l.week_start BETWEEN c.first_week AND c.last_week
  GROUP BY l.stock_code, l.week_start""")


def weekly_sql(codes: str) -> str:
    return f"""
  SELECT t.*, CAST(date_diff('day', c.first_week, t.week_start) / 7 AS INTEGER) AS week_idx FROM (
    SELECT 'All products' AS series, w.week_start, CAST(coalesce(a.units, 0) AS BIGINT) AS units, TRUE AS is_all
    FROM weeks w LEFT JOIN (SELECT week_start, sum(units) AS units FROM sku_week GROUP BY week_start) a
      USING (week_start)
    UNION ALL
    SELECT k.stock_code, w.week_start, CAST(coalesce(s.units, 0) AS BIGINT), FALSE
    FROM (SELECT stock_code FROM {codes}) k CROSS JOIN weeks w
    LEFT JOIN sku_week s ON s.stock_code = k.stock_code AND s.week_start = w.week_start) t, cal c"""


cte("weekly_top", weekly_sql("top5"))
cte("weekly_every", weekly_sql("(SELECT DISTINCT stock_code FROM series_lines) d"))


def lagged_sql(src: str) -> str:
    lags = ",\n         ".join(
        f"CAST(lag(units, {k}) OVER (PARTITION BY series ORDER BY week_start) AS DOUBLE) AS lag_{k}"
        for k in range(1, 9))
    return f"SELECT *,\n         {lags}\n  FROM {src}"


def method_sql() -> dict[str, str]:
    mean4 = "((((lag_4 + lag_3) + lag_2) + lag_1) / 4.0)"
    mean8 = "(" + "(" * 7 + "lag_8" + "".join(f" + lag_{k})" for k in range(7, 0, -1)) + " / 8.0)"
    slope = None
    for k in range(8, 0, -1):
        term = f"({LIT(4.5 - k)} * lag_{k})"
        slope = term if slope is None else f"({slope} + {term})"
    slope = f"({slope} / {LIT(42.0)})"
    cap = f"({LIT(0.18)} * greatest({LIT(1.0)}, {mean8}))"
    clipped = f"least(greatest({slope}, -{cap}), {cap})"
    steps = "CASE horizon " + " ".join(f"WHEN {i + 1} THEN {LIT(s)}" for i, s in enumerate(DAMPED_STEPS)) + " END"
    repeat = "CASE horizon WHEN 1 THEN lag_4 WHEN 2 THEN lag_3 WHEN 3 THEN lag_2 ELSE lag_1 END"
    return {
        "four_week_mean": f"greatest({mean4}, {LIT(0.0)})",
        "four_week_repeat": f"greatest({repeat}, {LIT(0.0)})",
        "eight_week_damped_trend": f"greatest({mean4} + {clipped} * ({steps}), {LIT(0.0)})",
    }


def forecasts_sql(src: str, methods=("four_week_mean", "four_week_repeat", "eight_week_damped_trend"),
                  origin_filter: str = "TRUE") -> str:
    m = method_sql()
    parts = [f"""
    SELECT series, origin, kind, fold, horizon, week_start, '{name}' AS method, {m[name]} AS forecast FROM anchor_rows"""
             for name in methods]
    return f"""
  SELECT * FROM (
    WITH anchor_rows AS (
      SELECT x.series, o.origin, o.kind, o.fold, h.horizon,
             CAST(o.origin + CAST(7 * (h.horizon - 1) AS INTEGER) AS DATE) AS week_start,
             x.lag_1, x.lag_2, x.lag_3, x.lag_4, x.lag_5, x.lag_6, x.lag_7, x.lag_8
      FROM ({lagged_sql(src)}) x
      JOIN origins o ON x.week_start = o.origin
      CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS horizon) h
      WHERE x.week_idx >= 8 AND {origin_filter})
    {" UNION ALL ".join(parts)}) f"""


cte("fc_top", forecasts_sql("weekly_top"))
cte("fca_top", """
  SELECT f.*, w.units AS actual FROM fc_top f
  LEFT JOIN weekly_top w ON w.series = f.series AND w.week_start = f.week_start""")

cte("folds", """
  SELECT series, origin, method, sum(abs(actual - forecast)) AS absolute_error,
         CAST(sum(abs(actual)) AS DOUBLE) AS actual_total,
         CASE WHEN CAST(sum(abs(actual)) AS DOUBLE) <> 0
              THEN 100.0 * sum(abs(actual - forecast)) / CAST(sum(abs(actual)) AS DOUBLE) END AS wape
  FROM fca_top WHERE kind = 'validation' GROUP BY series, origin, method""")

cte("scores", """
  SELECT series, method, sum(absolute_error) AS absolute_error, sum(actual_total) AS actual_total,
         CASE WHEN sum(actual_total) <> 0 THEN 100.0 * sum(absolute_error) / sum(actual_total) END
           AS validation_wape
  FROM folds GROUP BY series, method""")

cte("chosen", f"""
  SELECT * FROM scores QUALIFY row_number() OVER (
    PARTITION BY series ORDER BY {R('validation_wape', 8)} ASC NULLS LAST,
      CASE method WHEN 'four_week_mean' THEN 0 WHEN 'four_week_repeat' THEN 1 ELSE 2 END) = 1""")

cte("names", """
  SELECT 'All products' AS series, 'All product units' AS product
  UNION ALL
  SELECT t.stock_code, coalesce(m.product, 'Unknown') FROM top5 t LEFT JOIN (
    SELECT stock_code, description AS product FROM (
      SELECT stock_code, description, row_number() OVER (
               PARTITION BY stock_code ORDER BY count(*) DESC, description ASC) AS rn
      FROM initial_lines WHERE description IS NOT NULL AND stock_code IN (SELECT stock_code FROM top5)
      GROUP BY stock_code, description) r WHERE rn = 1) m USING (stock_code)""")

cte("holdout", """
  SELECT s.series, n.product, s.week_start, s.method, CAST(s.actual AS BIGINT) AS actual_units,
         s.forecast, b.forecast AS baseline
  FROM fca_top s
  JOIN chosen c ON c.series = s.series AND c.method = s.method
  JOIN fca_top b ON b.series = s.series AND b.week_start = s.week_start AND b.kind = 'test'
                 AND b.method = 'four_week_mean'
  JOIN names n ON n.series = s.series
  WHERE s.kind = 'test'""")

SQL: dict[str, str] = {}


def q(name: str, final: str) -> None:
    SQL[name] = with_ctes(final)


q("weekly_units", "SELECT series, week_start, units FROM weekly_every")
q("sku_popularity", "SELECT stock_code, orders, active_weeks FROM pop")
q("select_series", "SELECT stock_code, orders, active_weeks, pool_rank, top_rank FROM selection")
q("semi_join_selected", "SELECT series, week_start, units FROM weekly_every WHERE series IN (SELECT stock_code FROM top5)")
q("subset_check_except", "SELECT stock_code FROM top5 EXCEPT ALL SELECT stock_code FROM pool")
for key, method in [("forecast_four_week_mean", "four_week_mean"),
                    ("forecast_four_week_repeat", "four_week_repeat"),
                    ("forecast_damped_trend", "eight_week_damped_trend")]:
    q(key, f"""SELECT series, origin, horizon, week_start, method, {R('forecast', 6)} AS forecast
               FROM fc_top WHERE method = '{method}'""")
q("forecast_union_methods", f"SELECT series, origin, horizon, week_start, method, {R('forecast', 6)} AS forecast FROM fc_top")
q("wape", f"""
SELECT series, method, {R("CASE WHEN CAST(sum(abs(actual)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual - forecast)) / CAST(sum(abs(actual)) AS DOUBLE) END", 6)} AS wape
FROM fca_top WHERE kind = 'test' GROUP BY series, method""")
q("backtest_folds", f"""
SELECT series, origin, method, {R('absolute_error', 6)} AS absolute_error, {R('actual_total', 6)} AS actual_total,
       {R('wape', 6)} AS wape FROM folds""")
q("method_selection", f"""
SELECT c.series, n.product, c.method, {R('c.validation_wape', 2)} AS validation_wape
FROM chosen c JOIN names n USING (series)""")
q("holdout_weeks", f"""
SELECT series, product, week_start, actual_units, {R('forecast', 1)} AS forecast_units,
       {R('baseline', 1)} AS baseline_units FROM holdout""")
q("holdout_evaluation", f"""
SELECT series, product, method AS selected_method,
       {R("CASE WHEN CAST(sum(abs(actual_units)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual_units - forecast)) / CAST(sum(abs(actual_units)) AS DOUBLE) END", 2)} AS holdout_wape,
       {R("CASE WHEN CAST(sum(abs(actual_units)) AS DOUBLE) <> 0 THEN 100.0 * sum(abs(actual_units - baseline)) / CAST(sum(abs(actual_units)) AS DOUBLE) END", 2)} AS baseline_holdout_wape,
       CAST(sum(actual_units) AS BIGINT) AS actual_total, {R('sum(forecast)', 1)} AS forecast_total,
       {R('sum(baseline)', 1)} AS baseline_forecast_total
FROM holdout GROUP BY series, product, method""")
q("weekly_history_wide", """
SELECT w.week_start, max(CASE WHEN w.is_all THEN w.units END) AS all_products,
       max(CASE WHEN t.top_rank = 1 THEN w.units END) AS sku_1,
       max(CASE WHEN t.top_rank = 2 THEN w.units END) AS sku_2,
       max(CASE WHEN t.top_rank = 3 THEN w.units END) AS sku_3,
       max(CASE WHEN t.top_rank = 4 THEN w.units END) AS sku_4,
       max(CASE WHEN t.top_rank = 5 THEN w.units END) AS sku_5
FROM weekly_top w LEFT JOIN top5 t ON w.series = t.stock_code GROUP BY w.week_start""")

# What an origin sees: its forecasts, its features (four horizons of every
# series), and the training anchors whose target weeks lie before it.
q("leakage_check", """
SELECT 'forecasts' AS check_name, origin, count(*) AS compared, CAST(0 AS BIGINT) AS differing
FROM fc_top GROUP BY origin
UNION ALL
SELECT 'features', o.origin, count(*) * 4, 0 FROM weekly_top w JOIN origins o ON w.week_start = o.origin
GROUP BY o.origin
UNION ALL
SELECT 'training', o.origin, count(*) * 4, 0 FROM weekly_top w JOIN origins o ON w.week_start <= o.origin - 28
WHERE w.week_idx >= 8 GROUP BY o.origin""")

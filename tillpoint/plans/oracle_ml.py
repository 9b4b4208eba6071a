"""Oracle SQL for the feature panel, training frame and scoring frame."""

from __future__ import annotations

from tillpoint.plans.oracle_base import R, cte, with_ctes
from tillpoint.plans.oracle_forecasting import LIT, lagged_sql, weekly_sql

cte("weekly_pool", weekly_sql("pool"))


def _sum(ks) -> str:
    ks = list(ks)
    out = f"lag_{ks[0]}"
    for k in ks[1:]:
        out = f"({out} + lag_{k})"
    return out


def _mean(ks) -> str:
    ks = list(ks)
    return f"({_sum(ks)} / {LIT(len(ks))})"


def _std(ks) -> str:
    ks = list(ks)
    m = _mean(ks)
    out = None
    for k in ks:
        d = f"((lag_{k} - {m}) * (lag_{k} - {m}))"
        out = d if out is None else f"({out} + {d})"
    return f"sqrt({out} / {LIT(len(ks))})"


def _nz(ks) -> str:
    out = None
    for k in ks:
        t = f"(CASE WHEN lag_{k} <> 0 THEN {LIT(1.0)} ELSE {LIT(0.0)} END)"
        out = t if out is None else f"({out} + {t})"
    return out


RECENT, OLDER, PAST = [4, 3, 2, 1], [8, 7, 6, 5], list(range(8, 0, -1))
MEAN4, MEAN8 = _mean(RECENT), _mean(PAST)

_feats = {
    "horizon": "CAST(h AS DOUBLE)",
    **{f"lag_{k}_ratio": f"(lag_{k} / scale)" for k in range(1, 9)},
    "mean_4_ratio": f"({MEAN4} / scale)",
    "mean_8_ratio": f"({MEAN8} / scale)",
    "std_4_ratio": f"({_std(RECENT)} / scale)",
    "std_8_ratio": f"({_std(PAST)} / scale)",
    "recent_vs_prior_4": f"(({MEAN4} - {_mean(OLDER)}) / scale)",
    "positive_weeks_4": f"({_nz(RECENT)} / {LIT(4.0)})",
    "positive_weeks_8": f"({_nz(PAST)} / {LIT(8.0)})",
    "log_recent_scale": f"ln({LIT(1.0)} + {MEAN4})",
    "log_mean_8": f"ln({LIT(1.0)} + {MEAN8})",
    "target_week_of_year": "CAST(weekofyear(target_week) AS DOUBLE)",
    "target_month": "CAST(month(target_week) AS DOUBLE)",
    "is_all_products": f"(CASE WHEN is_all THEN {LIT(1.0)} ELSE {LIT(0.0)} END)",
}

_leads = ",\n         ".join(
    f"lead(units, {j}) OVER (PARTITION BY series ORDER BY week_start) AS lead_{j}" for j in range(4))

cte("panel", f"""
  SELECT series, week_start AS anchor_week, target_week,
         CAST(CASE h WHEN 1 THEN lead_0 WHEN 2 THEN lead_1 WHEN 3 THEN lead_2 ELSE lead_3 END AS DOUBLE) AS target_units,
         scale,
         {", ".join(f"{expr} AS {name}" for name, expr in _feats.items())}
  FROM (
    SELECT b.*, hh.h, CAST(b.week_start + CAST(7 * (hh.h - 1) AS INTEGER) AS DATE) AS target_week,
           greatest({LIT(1.0)}, {MEAN8}) AS scale
    FROM (SELECT *, {_leads} FROM ({lagged_sql("weekly_pool")}) l0) b
    CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS h) hh
    WHERE b.week_idx >= 8) p""")

SQL: dict[str, str] = {}
_f6 = ", ".join(f"{R(n, 6)} AS {n}" for n in _feats)

SQL["panel_features"] = with_ctes(f"""
SELECT series, anchor_week, target_week, {R('target_units', 6)} AS target_units, {R('scale', 6)} AS scale, {_f6}
FROM panel""")

SQL["panel_training"] = with_ctes(f"""
SELECT series, anchor_week, target_week, {R('target_units', 6)} AS target_units, {R('scale', 6)} AS scale, {_f6},
       {R(f"least({LIT(20.0)}, target_units / scale)", 6)} AS label,
       {R(f"CASE WHEN is_all_products = 1.0 THEN {LIT(2.0)} ELSE {LIT(1.0)} END", 6)} AS weight
FROM panel, cal WHERE anchor_week <= test_origin - 28""")

SQL["scoring_frame"] = with_ctes(f"""
SELECT series, anchor_week, target_week, {R('scale', 6)} AS scale, {_f6}
FROM panel, cal WHERE anchor_week = test_origin""")

SQL["stat_scores"] = with_ctes(f"""
SELECT series, method, {R('absolute_error', 6)} AS absolute_error, {R('actual_total', 6)} AS actual_total,
       {R('validation_wape', 6)} AS validation_wape FROM scores""")

SQL["stat_selection"] = with_ctes(f"""
SELECT c.series, n.product, c.method AS selected_by_validation, {R('c.validation_wape', 6)} AS validation_wape
FROM chosen c JOIN names n USING (series)""")

SQL["stat_methods_wide"] = with_ctes(f"""
SELECT week_start, CAST(first(actual) AS DOUBLE) AS actual_units,
       {R("max(CASE WHEN method = 'four_week_mean' THEN forecast END)", 6)} AS mean_forecast,
       {R("max(CASE WHEN method = 'four_week_repeat' THEN forecast END)", 6)} AS repeat_forecast,
       {R("max(CASE WHEN method = 'eight_week_damped_trend' THEN forecast END)", 6)} AS damped_forecast
FROM fca_top WHERE kind = 'test' AND series = 'All products' GROUP BY week_start""")


# The tree comparison over stored predictions.  The models themselves are not
# SQL; their forecasts are a table of the prediction store, and all that the
# comparison does with it is.  The caller registers that table as the view
# ``stored`` (series, origin, horizon, week_start, method, forecast).
cte("fca_all", """
  SELECT series, origin, kind, method, week_start, forecast, actual FROM fca_top
  UNION ALL
  SELECT s.series, s.origin, o.kind, s.method, s.week_start, s.forecast, w.units
  FROM stored s JOIN origins o ON o.origin = s.origin
  JOIN weekly_top w ON w.series = s.series AND w.week_start = s.week_start""")

_WAPE = "CASE WHEN {at} <> 0 THEN 100.0 * {ae} / {at} END"

cte("folds_all", f"""
  SELECT series, origin, method, ae AS absolute_error, total AS actual_total, {_WAPE.format(ae="ae", at="total")} AS wape
  FROM (SELECT series, origin, method, sum(abs(actual - forecast)) AS ae, CAST(sum(abs(actual)) AS DOUBLE) AS total
        FROM fca_all WHERE kind = 'validation' GROUP BY series, origin, method) t""")

cte("scores_all", f"""
  SELECT series, method, ae AS absolute_error, total AS actual_total, {_WAPE.format(ae="ae", at="total")} AS validation_wape
  FROM (SELECT series, method, sum(absolute_error) AS ae, sum(actual_total) AS total
        FROM folds_all GROUP BY series, method) t""")

cte("chosen_all", """
  SELECT series, method, validation_wape FROM scores_all
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY validation_wape NULLS LAST, list_position(
    ['four_week_mean', 'four_week_repeat', 'eight_week_damped_trend', 'random_forest', 'xgboost'], method)) = 1""")

cte("holdout_all", f"""
  SELECT t.series, n.product, t.method, s.validation_wape, {_WAPE.format(ae="ae", at="total")} AS holdout_wape,
         total AS actual_total, forecast_total, t.method = c.method AS selected_by_validation
  FROM (SELECT series, method, sum(abs(actual - forecast)) AS ae, CAST(sum(abs(actual)) AS DOUBLE) AS total,
               sum(forecast) AS forecast_total
        FROM fca_all WHERE kind = 'test' GROUP BY series, method) t
  JOIN scores_all s ON s.series = t.series AND s.method = t.method
  JOIN chosen_all c ON c.series = t.series JOIN names n ON n.series = t.series""")

STORED_SQL = {
    "ml_backtest": with_ctes("""
SELECT f.series, n.product, f.origin, f.method, f.absolute_error, f.actual_total, f.wape
FROM folds_all f JOIN names n USING (series)"""),
    "ml_scores": with_ctes("SELECT * FROM scores_all"),
    "ml_selection": with_ctes("""
SELECT c.series, n.product, c.method AS selected_by_validation, c.validation_wape
FROM chosen_all c JOIN names n USING (series)"""),
    "ml_holdout": with_ctes("SELECT * FROM holdout_all"),
    "ml_vs_baseline": with_ctes("""
SELECT h.series, h.product, h.method AS selected_method, h.holdout_wape AS selected_holdout_wape,
       b.holdout_wape AS baseline_holdout_wape, h.holdout_wape - b.holdout_wape AS wape_change
FROM holdout_all h JOIN holdout_all b ON b.series = h.series AND b.method = 'four_week_mean'
WHERE h.selected_by_validation"""),
    "ml_holdout_weeks": with_ctes("""
SELECT a.series, n.product, a.week_start, a.method, CAST(a.actual AS DOUBLE) AS actual_units,
       a.forecast AS forecast_units, a.method = c.method AS selected_by_validation
FROM fca_all a JOIN chosen_all c ON c.series = a.series JOIN names n ON n.series = a.series WHERE a.kind = 'test'"""),
}

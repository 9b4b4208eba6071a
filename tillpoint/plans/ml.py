"""Registered ML queries: feature panel, training/scoring frames, tree
models, and the five-method comparison backtest."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, wape_expr
from tillpoint.operators import forecast as fc
from tillpoint.operators import ml
from tillpoint.plans.context import Ctx
from tillpoint.plans.forecasting import (cal, folds, materialized, memo, names, origins, selection,
                                         stat_forecasts, top)
from tillpoint.sources.staging import staged

ALL_METHODS = fc.METHODS + ml.ML_METHODS


def pool_weekly(c: Ctx) -> DataFrame:
    return materialized(c, "pool_weekly", lambda: fc.weekly_units(c.series_lines, cal(c), fc.pool_codes(selection(c))))


def panel(c: Ctx) -> DataFrame:
    return memo(c, "panel", lambda: ml.panel_features(pool_weekly(c)))


def reported_series(c: Ctx) -> DataFrame:
    s = top(c).select(F.col("stock_code").alias("series"))
    return s.unionByName(c.spark.createDataFrame([(fc.ALL_SERIES,)], "series string"))


def fits_in_flight(c: Ctx, partitions: int, fits: int) -> int:
    """Fits that run side by side: each is a chain of small stages that keeps
    its tasks busy about half the time, with bounded memory of its own."""
    return min(fits, max(1, 2 * c.spark.sparkContext.defaultParallelism // partitions))


def tree_tasks(c: Ctx) -> list[tuple]:
    return [(o[0], m) for o in cal(c).origin_rows() for m in ml.ML_METHODS]


def stored_forecasts(c: Ctx, panel_df: DataFrame, partitions: int, origin, method: str) -> DataFrame:
    """The forecasts of one fit from the prediction store, a staged table for
    each (input, origin, model): a fit that an earlier application completed is
    read, so a restarted driver goes on where the last one stopped."""
    return staged(c.spark, c.sf_dir, lambda: ml.ml_forecasts(panel_df, origin, method, partitions),
                  name=f"trees-{method}-{ml.model_key(method)}-{origin:%Y%m%d}")


def pool_forecasts(c: Ctx) -> DataFrame:
    """Tree forecasts of the whole pool at every origin.  A bounded number of
    fits run side by side."""
    return materialized(c, "pool_forecasts", lambda: _pool_forecasts(c))


def _pool_forecasts(c: Ctx) -> DataFrame:
    p = materialized(c, "panel", lambda: panel(c))  # every fit reads it
    partitions, tasks = ml.fit_partitions(p.count()), tree_tasks(c)
    with ThreadPoolExecutor(max_workers=fits_in_flight(c, partitions, len(tasks))) as pool:
        tree = list(pool.map(lambda task: stored_forecasts(c, p, partitions, *task), tasks))
    return reduce(DataFrame.unionByName, tree).join(F.broadcast(origins(c)), "origin").select(
        "series", "origin", "kind", "fold", "horizon", "week_start", "method", "prediction", "scale", "forecast")


def reported_weekly(c: Ctx) -> DataFrame:
    return pool_weekly(c).join(F.broadcast(reported_series(c)), "series", "left_semi")


def all_forecasts(c: Ctx) -> DataFrame:
    """Statistical and tree forecasts of the reported series, with actuals."""
    weekly, columns = reported_weekly(c), ["series", "origin", "kind", "fold", "horizon", "week_start", "method", "forecast"]
    tree = pool_forecasts(c).join(F.broadcast(reported_series(c)), "series", "left_semi").select(columns)
    return fc.with_actuals(fc.forecasts(weekly, origins(c)).select(columns).unionByName(tree), weekly)


def ml_folds(c: Ctx) -> DataFrame:
    return memo(c, "ml_folds", lambda: fc.backtest_folds(all_forecasts(c)))


def ml_scores(c: Ctx) -> DataFrame:
    return memo(c, "ml_scores", lambda: fc.pooled_scores(ml_folds(c)))


def ml_selected(c: Ctx) -> DataFrame:
    return memo(c, "ml_selected", lambda: fc.select_method(ml_scores(c), ALL_METHODS, round_digits=None))


def ml_holdout(c: Ctx) -> DataFrame:
    """Per series x method at the test origin, with the validation score
    and the SelectedByValidation flag."""
    t = all_forecasts(c).where(F.col("kind") == "test")
    g = t.groupBy("series", "method").agg(
        F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("ae"),
        F.sum(F.abs(F.col("actual"))).cast("double").alias("at"),
        F.sum("actual").cast("double").alias("actual_total"),
        F.sum("forecast").alias("forecast_total"))
    sel = ml_selected(c).select("series", F.col("method").alias("chosen"))
    return (g.join(ml_scores(c).select("series", "method", "validation_wape"), ["series", "method"])
            .join(sel, "series").join(names(c), "series")
            .select("series", "product", "method", "validation_wape",
                    wape_expr(F.col("ae"), F.col("at")).alias("holdout_wape"),
                    "actual_total", "forecast_total",
                    (F.col("method") == F.col("chosen")).alias("selected_by_validation")))


def ml_holdout_weeks(c: Ctx) -> DataFrame:
    t = all_forecasts(c).where(F.col("kind") == "test")
    sel = ml_selected(c).select("series", F.col("method").alias("chosen"))
    return (t.join(sel, "series").join(names(c), "series")
            .select("series", "product", "week_start", "method",
                    F.col("actual").cast("double").alias("actual_units"),
                    F.col("forecast").alias("forecast_units"),
                    (F.col("method") == F.col("chosen")).alias("selected_by_validation")))


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[dround(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _panel_out(c: Ctx) -> DataFrame:
    p = panel(c).drop("week_idx")
    return _r6(p, "target_units", "scale", *ml.FEATURE_NAMES)


def _training_out(c: Ctx) -> DataFrame:
    t = ml.training_frame(panel(c), cal(c).test_origin).drop("week_idx")
    return _r6(t, "target_units", "scale", "label", "weight", *ml.FEATURE_NAMES)


def _scoring_out(c: Ctx) -> DataFrame:
    s = ml.scoring_frame(panel(c), cal(c).test_origin).drop("week_idx", "target_units")
    return _r6(s, "scale", *ml.FEATURE_NAMES)


def _model_out(c: Ctx, method: str) -> DataFrame:
    t = pool_forecasts(c).where((F.col("kind") == "test") & (F.col("method") == method))
    return t.select("series", "origin", "horizon", "week_start", "method", "forecast")


def _rescale_out(c: Ctx) -> DataFrame:
    """Predicted ratio -> units for the forest at the test origin."""
    f = pool_forecasts(c).where((F.col("kind") == "test") & (F.col("method") == "random_forest"))
    return ml.rescale(f.drop("forecast")).select("series", "week_start", "scale", "prediction", "forecast")


def _backtest_out(c: Ctx) -> DataFrame:
    return ml_folds(c).join(names(c), "series").select(
        "series", "product", "origin", "method", "absolute_error", "actual_total", "wape")


def _stat_scores(c: Ctx) -> DataFrame:
    """Pooled scores of the statistical methods alone."""
    return fc.pooled_scores(folds(c))


def _stat_scores_out(c: Ctx) -> DataFrame:
    return _r6(_stat_scores(c).select("series", "method", "absolute_error", "actual_total", "validation_wape"),
               "absolute_error", "actual_total", "validation_wape")


def _stat_selection_out(c: Ctx) -> DataFrame:
    chosen = fc.select_method(_stat_scores(c))
    return chosen.join(names(c), "series").select(
        "series", "product", F.col("method").alias("selected_by_validation"), dround("validation_wape", 6).alias("validation_wape"))


def _stat_methods_wide(c: Ctx) -> DataFrame:
    weeks = stat_forecasts(c).where(F.col("kind") == "test").select(
        "series", "week_start", "method", F.col("actual").cast("double").alias("actual_units"),
        F.col("forecast").alias("forecast_units"))
    wide = methods_wide(weeks, {"four_week_mean": "mean_forecast", "four_week_repeat": "repeat_forecast",
                                "eight_week_damped_trend": "damped_forecast"})
    return _r6(wide, "mean_forecast", "repeat_forecast", "damped_forecast")


def _scores_out(c: Ctx) -> DataFrame:
    return ml_scores(c).select("series", "method", "absolute_error", "actual_total", "validation_wape")


def _selection_out(c: Ctx) -> DataFrame:
    return ml_selected(c).join(names(c), "series").select(
        "series", "product", F.col("method").alias("selected_by_validation"), "validation_wape")


def _vs_baseline(c: Ctx) -> DataFrame:
    h = ml_holdout(c)
    chosen = h.where("selected_by_validation").select(
        "series", "product", F.col("method").alias("selected_method"),
        F.col("holdout_wape").alias("selected_holdout_wape"))
    base = h.where(F.col("method") == "four_week_mean").select(
        "series", F.col("holdout_wape").alias("baseline_holdout_wape"))
    return chosen.join(base, "series").withColumn(
        "wape_change", F.col("selected_holdout_wape") - F.col("baseline_holdout_wape"))


METHOD_COLUMNS = {"four_week_mean": "mean_forecast", "eight_week_damped_trend": "damped_forecast",
                  "random_forest": "random_forest_forecast", "xgboost": "xgboost_forecast"}


def methods_wide(weeks: DataFrame, cols: dict[str, str] = METHOD_COLUMNS) -> DataFrame:
    """All-products test weeks, one column per method (RS2)."""
    a = weeks.where(F.col("series") == fc.ALL_SERIES)
    wide = a.groupBy("week_start").pivot("method", list(cols)).agg(F.first("forecast_units"))
    actual = a.where(F.col("method") == "four_week_mean").select("week_start", "actual_units")
    return actual.join(wide, "week_start").select(
        "week_start", "actual_units", *[F.col(m).alias(n) for m, n in cols.items()])


QUERIES = {
    "panel_features": _panel_out,
    "panel_training": _training_out,
    "scoring_frame": _scoring_out,
    "ml_random_forest": lambda c: _model_out(c, "random_forest"),
    "ml_boosted_trees": lambda c: _model_out(c, "xgboost"),
    "ml_rescale": _rescale_out,
    "ml_backtest": _backtest_out,
    "ml_scores": _scores_out,
    "ml_selection": _selection_out,
    "ml_holdout": ml_holdout,
    "ml_holdout_weeks": ml_holdout_weeks,
    "ml_vs_baseline": _vs_baseline,
    "ml_methods_wide": lambda c: methods_wide(ml_holdout_weeks(c)),
    "stat_scores": _stat_scores_out,
    "stat_selection": _stat_selection_out,
    "stat_methods_wide": _stat_methods_wide,
}

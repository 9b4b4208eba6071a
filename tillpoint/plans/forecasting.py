"""Registered forecasting queries (statistical methods)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround
from tillpoint.operators import forecast as fc
from tillpoint.operators import ml
from tillpoint.plans.context import Ctx
from tillpoint.session import ensure_checkpoint_dir
from tillpoint.sources.staging import shared


def memo(c: Ctx, name: str, build):
    if not hasattr(c, "_memo"):
        c._memo = {}
    if name not in c._memo:
        c._memo[name] = build()
    return c._memo[name]


def per_input(c: Ctx, name: str, build):
    """Memoised per application and input (see ``staging.shared``)."""
    return memo(c, name, lambda: shared(c.spark, c.sf_dir, name, build))


def materialized(c: Ctx, name: str, build):
    """Checkpointed once per input and application: tables bounded by the pool
    size and the calendar, which many queries and branches read."""
    def run():
        ensure_checkpoint_dir(c.spark)
        return build().checkpoint(eager=True)
    return per_input(c, name, run)


def cal(c: Ctx):
    """From the latest timestamps of the invoice grain; the lines are not read."""
    return per_input(c, "cal", lambda: fc.calendar(c.invoice_facts.select(F.col("last_ts").alias("invoice_date"))))


def popularity(c: Ctx):
    return memo(c, "pop", lambda: fc.sku_popularity(c.series_lines, cal(c)))


def selection(c: Ctx):
    return materialized(c, "sel", lambda: fc.select_series(popularity(c)))


def top(c: Ctx):
    return fc.top_codes(selection(c))


def stat_weekly(c: Ctx):
    """All products + the reported top SKUs (semi-join on the selection)."""
    return materialized(c, "stat_weekly", lambda: fc.weekly_units(c.series_lines, cal(c), top(c)))


def origins(c: Ctx):
    return fc.origins(c.spark, cal(c))


def stat_forecasts(c: Ctx, methods=fc.METHODS):
    return fc.with_actuals(fc.forecasts(stat_weekly(c), origins(c), methods), stat_weekly(c))


def folds(c: Ctx):
    return memo(c, "folds", lambda: fc.backtest_folds(stat_forecasts(c)))


def names(c: Ctx):
    return materialized(c, "names", lambda: fc.product_names(c.series_lines, cal(c), top(c)))


def selected(c: Ctx):
    return memo(c, "selected", lambda: fc.select_method(fc.pooled_scores(folds(c))))


def holdout(c: Ctx):
    return memo(c, "holdout", lambda: fc.holdout_weeks(stat_forecasts(c), selected(c), names(c)))


def _forecast_out(c: Ctx, methods):
    f = fc.forecasts(stat_weekly(c), origins(c), methods)
    return f.select("series", "origin", "horizon", "week_start", "method",
                    dround("forecast", 6).alias("forecast"))


def _folds_out(c: Ctx):
    return folds(c).select("series", "origin", "method", dround("absolute_error", 6).alias("absolute_error"),
                           dround("actual_total", 6).alias("actual_total"), dround("wape", 6).alias("wape"))


def _selection_out(c: Ctx):
    return selected(c).join(names(c), "series").select(
        "series", "product", "method", dround("validation_wape", 2).alias("validation_wape"))


def _holdout_out(c: Ctx):
    return holdout(c).select("series", "product", "week_start", "actual_units",
                             dround("forecast", 1).alias("forecast_units"),
                             dround("baseline", 1).alias("baseline_units"))


def _wape(c: Ctx):
    t = stat_forecasts(c).where(F.col("kind") == "test")
    g = t.groupBy("series", "method").agg(F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("ae"),
                                          F.sum(F.abs(F.col("actual"))).cast("double").alias("at"))
    return g.select("series", "method", dround(fc.wape_expr(F.col("ae"), F.col("at")), 6).alias("wape"))


def _history_wide(c: Ctx, n: int = fc.TOP_N):
    w = stat_weekly(c).join(F.broadcast(top(c)), F.col("series") == F.col("stock_code"), "left")
    cols = [F.max(F.when(F.col("is_all"), F.col("units"))).alias("all_products")]
    cols += [F.max(F.when(F.col("top_rank") == i, F.col("units"))).alias(f"sku_{i}") for i in range(1, n + 1)]
    return w.groupBy("week_start").agg(*cols)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the rows of ``a``, and how many rows only one side has."""
    sides = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return (sides.groupBy(*a.columns).agg(F.sum("_side").alias("d"), F.count_if(F.col("_side") == 1).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("compared"),
                 F.coalesce(F.sum(F.abs("d")), F.lit(0)).cast("bigint").alias("differing")))


def leakage(weekly: DataFrame, origins_df: DataFrame, dates: list) -> DataFrame:
    """One row for each origin and kind of input: what an origin sees must not
    change when every week from it on is overwritten."""
    out = None
    for origin in dates:
        changed = weekly.withColumn("units", F.when(F.col("week_start") >= F.lit(origin), F.lit(10 ** 8))
                                    .otherwise(F.col("units")))
        o = origins_df.where(F.col("origin") == F.lit(origin))
        looks = {
            "forecasts": lambda w: fc.forecasts(w, o).select("series", "horizon", "method", "forecast"),
            "features": lambda w: ml.scoring_frame(ml.panel_features(w), origin).drop("target_units"),
            "training": lambda w: ml.training_frame(ml.panel_features(w), origin),
        }
        for name, look in looks.items():
            one = differing(look(weekly), look(changed)).select(
                F.lit(name).alias("check_name"), F.lit(origin).alias("origin"), "compared", "differing")
            out = one if out is None else out.unionByName(one)
    return out


def _leakage(c: Ctx):
    return leakage(stat_weekly(c), origins(c), [o[0] for o in cal(c).origin_rows()])


def _semi_join_selected(c: Ctx):
    # The codes are restricted before the week grid is made for them.
    codes = c.series_lines.select("stock_code").distinct().join(F.broadcast(top(c)), "stock_code", "left_semi")
    weekly = fc.weekly_units(c.series_lines, cal(c), codes).where(~F.col("is_all"))
    return weekly.select("series", "week_start", "units")


def _subset_check(c: Ctx):
    return top(c).select("stock_code").exceptAll(fc.pool_codes(selection(c)).select("stock_code"))


QUERIES = {
    "weekly_units": lambda c: fc.weekly_units(c.series_lines, cal(c)).select("series", "week_start", "units"),
    "sku_popularity": lambda c: popularity(c),
    "select_series": lambda c: selection(c),
    "semi_join_selected": _semi_join_selected,
    "subset_check_except": _subset_check,
    "forecast_four_week_mean": lambda c: _forecast_out(c, ("four_week_mean",)),
    "forecast_four_week_repeat": lambda c: _forecast_out(c, ("four_week_repeat",)),
    "forecast_damped_trend": lambda c: _forecast_out(c, ("eight_week_damped_trend",)),
    "forecast_union_methods": lambda c: _forecast_out(c, fc.METHODS),
    "wape": _wape,
    "backtest_folds": _folds_out,
    "method_selection": _selection_out,
    "holdout_weeks": _holdout_out,
    "holdout_evaluation": lambda c: fc.holdout_evaluation(holdout(c)),
    "weekly_history_wide": _history_wide,
    "leakage_check": _leakage,
}

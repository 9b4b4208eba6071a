"""BI marts and their measures.

A measure is an aggregate Column over one mart; ``measure_frame`` applies
a set of them over the whole mart or per group (the visual's axes), under
slicers.  DIVIDE becomes a NULL-on-zero division; CALCULATE with a predicate
becomes a conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, safe_div


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def forecast_all(history: DataFrame, holdout: DataFrame) -> DataFrame:
    """All-products weekly history with the holdout forecasts (left join)."""
    h = history.where(F.col("is_all")).select("week_start", F.col("units").alias("observed_units"))
    f = holdout.where(F.col("series") == "All products").select("week_start", "forecast_units", "baseline_units")
    return (h.join(f, "week_start", "left")
            .withColumn("is_holdout", yes_no(F.col("forecast_units").isNotNull())))


def sku_errors(evaluation: DataFrame) -> DataFrame:
    return evaluation.where(F.col("series") != "All products")


def ml_model_scores(ml_holdout: DataFrame) -> DataFrame:
    return (ml_holdout.where(F.col("series") == "All products")
            .select("method", "validation_wape", "holdout_wape",
                    yes_no(F.col("selected_by_validation")).alias("selected_by_validation")))


class Sliced:
    """Aggregates of one mart under slicers, predicates by the column they read.

    A condition given as ``keep`` narrows the slicers (KEEPFILTERS or FILTER);
    ``replace`` names a column whose slicer the condition takes the place of
    (CALCULATE with a plain predicate).
    """

    def __init__(self, slicers: dict[str, Column] | None = None):
        self.slicers = slicers or {}

    def _where(self, keep: Column | None, replace: str | None) -> Column | None:
        tests = [p for c, p in self.slicers.items() if c != replace] + ([keep] if keep is not None else [])
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    def _pick(self, value, keep, replace) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        where = self._where(keep, replace)
        return value if where is None else F.when(where, value)

    def sum(self, value, keep: Column | None = None, replace: str | None = None) -> Column:
        return F.sum(self._pick(value, keep, replace))

    def avg(self, value, keep: Column | None = None, replace: str | None = None) -> Column:
        return F.avg(self._pick(value, keep, replace))

    def count(self, keep: Column | None = None) -> Column:
        return F.count(self._pick(F.lit(1), keep, None))


def _holdout() -> Column:
    return F.col("is_holdout") == "Yes"


def _holdout_wape(s: Sliced, forecast: str) -> Column:
    # The errors are those of the sliced rows; the units replace the slicer.
    return safe_div(s.sum(F.abs(F.col("observed_units") - F.col(forecast)), keep=_holdout()),
                    s.sum("observed_units", keep=_holdout(), replace="is_holdout"))


def _of_method(s: Sliced, value: str, method: str) -> Column:
    return s.avg(value, keep=F.col("method") == method, replace="method") / 100


# name -> (mart, builder of the aggregate Column under slicers)
MEASURES: dict[str, tuple[str, object]] = {
    "recorded_sales": ("sales", lambda s: s.sum("revenue")),
    "invoices": ("sales", lambda s: s.sum("orders")),
    "average_order_value": ("sales", lambda s: safe_div(s.sum("revenue"), s.sum("orders"))),
    "later_month_buyer_sales": ("sales", lambda s: s.sum("returning_later_month_revenue")),
    "later_month_buyer_share": ("sales", lambda s: safe_div(s.sum("returning_later_month_revenue"), s.sum("revenue"))),
    "customer_count": ("customers", lambda s: s.count()),
    "multiple_order_buyers": ("customers", lambda s: s.count(keep=F.col("orders") >= 2)),
    "multi_order_buyer_sales_share": ("customers", lambda s: safe_div(
        s.sum("revenue", keep=F.col("orders") >= 2), s.sum("revenue"))),
    "champion_sales_share": ("customers", lambda s: safe_div(
        s.sum("revenue", keep=F.col("segment") == "Champions"), s.sum("revenue"))),
    "customer_sales": ("customers", lambda s: s.sum("revenue")),
    "next_month_cohort_retention": ("cohort_month1", lambda s: safe_div(
        s.sum("customers_next_month"), s.sum("customers_in_cohort"))),
    "weekly_observed_units": ("forecast_all", lambda s: s.sum("observed_units")),
    "weekly_selected_forecast": ("forecast_all", lambda s: s.sum("forecast_units")),
    "weekly_baseline_forecast": ("forecast_all", lambda s: s.sum("baseline_units")),
    "actual_holdout_units": ("forecast_all", lambda s: s.sum("observed_units", keep=_holdout(), replace="is_holdout")),
    "selected_holdout_forecast": ("forecast_all", lambda s: s.sum("forecast_units")),
    "selected_holdout_wape": ("forecast_all", lambda s: _holdout_wape(s, "forecast_units")),
    "simple_holdout_wape": ("forecast_all", lambda s: _holdout_wape(s, "baseline_units")),
    "selected_sku_wape": ("forecast_sku_errors", lambda s: s.sum("holdout_wape")),
    "ml_validation_wape": ("ml_model_scores", lambda s: s.avg("validation_wape") / 100),
    "ml_holdout_wape": ("ml_model_scores", lambda s: s.avg("holdout_wape") / 100),
    "rf_validation_wape": ("ml_model_scores", lambda s: _of_method(s, "validation_wape", "random_forest")),
    "rf_holdout_wape": ("ml_model_scores", lambda s: _of_method(s, "holdout_wape", "random_forest")),
    "damped_holdout_wape": ("ml_model_scores", lambda s: _of_method(s, "holdout_wape", "eight_week_damped_trend")),
    "baseline_holdout_wape": ("ml_model_scores", lambda s: _of_method(s, "holdout_wape", "four_week_mean")),
    "ml_actual_units": ("ml_holdout", lambda s: s.sum("actual_units")),
    "ml_rf_forecast": ("ml_holdout", lambda s: s.sum("random_forest_forecast")),
    "ml_damped_forecast": ("ml_holdout", lambda s: s.sum("damped_forecast")),
    "ml_xgboost_forecast": ("ml_holdout", lambda s: s.sum("xgboost_forecast")),
    "ml_moving_average": ("ml_holdout", lambda s: s.sum("mean_forecast")),
}


# Money totals are reported to the cent; everything else to 6 dp.
MONEY_MEASURES = {"recorded_sales", "later_month_buyer_sales", "customer_sales"}


def measure_digits(name: str) -> int:
    return 2 if name in MONEY_MEASURES else 6


def measure_frame(mart: DataFrame, names: list[str], group_by: list[str] | None = None,
                  slicers: dict[str, Column] | None = None) -> DataFrame:
    """The measures over the whole mart or per group, under ``slicers``."""
    s = Sliced(slicers)
    aggs = [dround(MEASURES[n][1](s).cast("double"), measure_digits(n)).alias(n) for n in names]
    if group_by:
        return mart.groupBy(*group_by).agg(*aggs)
    return mart.agg(*aggs)

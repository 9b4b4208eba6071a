"""Registered BI marts measures (one key per measure) and grouped visuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators import customers as cu
from tillpoint.operators import forecast as fc
from tillpoint.operators import marts as mt
from tillpoint.operators import revenue as rv
from tillpoint.plans import forecasting as pf
from tillpoint.plans import ml as pm
from tillpoint.plans.context import Ctx

def _customers(c: Ctx) -> DataFrame:
    # The measures never read the surrogate key, so it is not built here.
    cc = cu.customer_country(c.invoices)
    return c.customers.join(cc, "customer_id").select(
        (F.col("revenue_cents") / 100.0).alias("revenue"), "orders", "recency_days", "country", "segment")


MARTS = {
    "sales": lambda c: rv.monthly_country(c.status),
    "customers": _customers,
    "cohort_month1": lambda c: cu.cohort_next_month(cu.cohort_retention(c.invoices)),
    "forecast_all": lambda c: mt.forecast_all(pf.stat_weekly(c), pf._holdout_out(c)),
    "forecast_sku_errors": lambda c: mt.sku_errors(fc.holdout_evaluation(pf.holdout(c))),
    "ml_model_scores": lambda c: mt.ml_model_scores(pm.ml_holdout(c)),
    "ml_holdout": lambda c: pm.methods_wide(pm.ml_holdout_weeks(c)),
}

# The marts as they are published: the customers with their surrogate key and
# first month, which no measure reads.
PUBLISHED = MARTS | {"customers": lambda c: cu.customer_metrics(c.customers, c.invoices)}

# Measures that read a fitted tree model (rows-only check).
TREE_MEASURES = {"ml_validation_wape", "ml_holdout_wape", "rf_validation_wape", "rf_holdout_wape",
                 "ml_rf_forecast", "ml_xgboost_forecast"}


def _measure(name: str, slicers: dict | None = None):
    mart = mt.MEASURES[name][0]

    def q(c: Ctx) -> DataFrame:
        return mt.measure_frame(MARTS[mart](c), [name], slicers={k: p() for k, p in (slicers or {}).items()})
    q.__name__ = f"m_{name}"
    return q


# One sliced measure of each kind: plain, KEEPFILTERS and replacing CALCULATE.
SLICED = {
    "recorded_sales": {"country": lambda: F.col("country") == "FRANCE"},
    "multiple_order_buyers": {"orders": lambda: F.col("orders") <= 3},
    "actual_holdout_units": {"is_holdout": lambda: F.col("is_holdout") == "No"},
    "selected_holdout_wape": {"is_holdout": lambda: F.col("is_holdout") == "No"},
}

QUERIES = {f"m_{n}": _measure(n) for n in mt.MEASURES}
QUERIES |= {f"m_{n}_sliced": _measure(n, slicers) for n, slicers in SLICED.items()}
QUERIES |= {f"mart_{n}": build for n, build in PUBLISHED.items()}
QUERIES.update({
    "bi_sales_by_month_country": lambda c: mt.measure_frame(
        MARTS["sales"](c), ["recorded_sales", "invoices", "average_order_value", "later_month_buyer_share"],
        ["month", "country"]),
    "bi_customers_by_segment": lambda c: mt.measure_frame(
        MARTS["customers"](c), ["customer_count", "customer_sales", "multiple_order_buyers",
                                "multi_order_buyer_sales_share", "champion_sales_share"], ["segment"]),
    "bi_cohort_next_month": lambda c: mt.measure_frame(
        MARTS["cohort_month1"](c), ["next_month_cohort_retention"], ["cohort_month"]),
    "bi_forecast_weekly": lambda c: mt.measure_frame(
        MARTS["forecast_all"](c), ["weekly_observed_units", "weekly_selected_forecast",
                                   "weekly_baseline_forecast"], ["week_start"]),
})

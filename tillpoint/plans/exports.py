"""Export jobs: the published marts, the metrics document and the forecast
facts.  Each job publishes one set (``sources.publish``): readers see all of
its files or those of the set before."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillpoint.plans import analytics, forecasting, marts, ml
from tillpoint.plans.context import Ctx
from tillpoint.sources.publish import Table, publish

# file name -> query
ANALYTICS = {
    "monthly": "monthly_summary", "monthly_country": "monthly_country", "country": "country_share",
    "products": "product_summary", "segments": "rfm_segments", "customer_metrics_anonymized": "customer_metrics",
    "cohort_retention": "cohort_retention", "invoice_status_summary": "status_by_month",
}
STATISTICAL = {
    "forecast_weekly_history": "weekly_history_wide", "forecast_validation_folds": "backtest_folds",
    "forecast_model_selection": "method_selection", "forecast_holdout_weeks": "holdout_weeks",
    "forecast_evaluation": "holdout_evaluation",
}
TREES = {
    "ml_validation_folds": "ml_backtest", "ml_validation_scores": "ml_scores", "ml_selected_methods": "ml_selection",
    "ml_holdout_weeks": "ml_holdout_weeks", "ml_holdout_comparison": "ml_holdout",
}


def _tables(c: Ctx, queries: dict, files: dict[str, str], fmt: str, money_digits: int | None = None) -> dict[str, Table]:
    return {name: Table(queries[query](c), fmt, money_digits=money_digits) for name, query in files.items()}


def _published(spark: SparkSession, tables: dict[str, Table], out: str) -> list[str]:
    publish(spark, tables, out)
    return list(tables)


def export_analytics(spark: SparkSession, sf_dir: str, out: str, fmt: str = "csv") -> list[str]:
    """The eight marts, with money to the cent, and the headline metrics."""
    c = Ctx(spark, sf_dir)
    tables = _tables(c, analytics.QUERIES, ANALYTICS, fmt, money_digits=2)
    return _published(spark, tables | {"verified_metrics": Table(analytics.QUERIES["headline_metrics"](c), "json")}, out)


def export_forecasts(spark: SparkSession, sf_dir: str, out: str, fmt: str = "csv") -> list[str]:
    return _published(spark, _tables(Ctx(spark, sf_dir), forecasting.QUERIES, STATISTICAL, fmt), out)


def export_trees(spark: SparkSession, sf_dir: str, out: str, fmt: str = "csv") -> list[str]:
    return _published(spark, _tables(Ctx(spark, sf_dir), ml.QUERIES, TREES, fmt), out)


def export_bi_marts(spark: SparkSession, sf_dir: str, out: str, names: tuple[str, ...] = tuple(marts.PUBLISHED)) -> list[str]:
    """The typed BI marts as compressed CSV."""
    c = Ctx(spark, sf_dir)
    return _published(spark, {name: Table(marts.PUBLISHED[name](c), "csv", "gzip", 2) for name in names}, out)

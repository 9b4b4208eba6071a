"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillpoint.plans import (
    analytics,
    dashboard,
    forecasting,
    marts,
    ml,
    oracle_analytics,
    oracle_dashboard,
    oracle_forecasting,
    oracle_marts,
    oracle_ml,
    views,
)
from tillpoint.plans.context import Ctx

_PLAN_MODULES = [analytics, views, forecasting, ml, marts, dashboard]
_ORACLE_MODULES = [oracle_analytics, oracle_forecasting, oracle_ml, oracle_marts, oracle_dashboard]


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bind(fn) for m in _PLAN_MODULES for k, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    own = {k: sql for m in _ORACLE_MODULES for k, sql in m.SQL.items()}
    return own | {name: own[key] for name, key in views.EQUALS.items()}

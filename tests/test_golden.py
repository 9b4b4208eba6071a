"""Golden checks against the reference's published inputs and outputs.

The published weekly history is the input of its statistical backtest and
the published folds are the input of its ML scoring; these tests feed the
same inputs through our operators and compare with the published outputs.
Reported as skipped unless TILLPOINT_GOLDEN_DIR names their folder;
test_forecast_methods holds the same operators against numpy on its own inputs.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN_DIR, reference_csv
from tillpoint.operators import forecast as fc
from tillpoint.operators.ml import ML_METHODS

pytestmark = pytest.mark.skipif(not GOLDEN_DIR, reason="TILLPOINT_GOLDEN_DIR is not set")
FOLD_SCHEMA = "Series string, Origin date, Method string, AbsoluteError double, ActualTotal double, WAPE double"


def _history(spark):
    df = spark.read.option("header", True).csv(reference_csv("forecast_weekly_history.csv"))
    cols = [c for c in df.columns if c != "WeekStart"]
    stack = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in cols)
    long = df.selectExpr("to_date(WeekStart) AS week_start", f"stack({len(cols)}, {stack}) AS (series, units)")
    first = dt.date(2010, 12, 6)
    return long.select("series", "week_start", "units",
                       (F.datediff("week_start", F.lit(first)) / 7).cast("int").alias("week_idx"),
                       (F.col("series") == fc.ALL_SERIES).alias("is_all"))


def _folds(spark):
    weekly = _history(spark)
    cal = fc.calendar_from_last_week(dt.date(2011, 11, 28))
    return fc.backtest_folds(fc.with_actuals(fc.forecasts(weekly, fc.origins(spark, cal)), weekly))


def test_statistical_backtest_matches_published_folds(spark):
    ours = _folds(spark)
    pub = (spark.read.schema(FOLD_SCHEMA).option("header", True).csv(reference_csv("forecast_validation_folds.csv"))
           .toDF("series", "origin", "method", "pub_ae", "pub_at", "pub_wape"))
    j = ours.join(pub, ["series", "origin", "method"])
    assert ours.count() == 90 and j.count() == 90
    worst = j.agg(F.max(F.abs(F.col("absolute_error") - F.col("pub_ae"))).alias("ae"),
                  F.max(F.abs(F.col("actual_total") - F.col("pub_at"))).alias("at"),
                  F.max(F.abs(F.col("wape") - F.col("pub_wape"))).alias("w")).first()
    assert worst.ae < 1e-6 and worst.at == 0 and worst.w < 1e-6


def test_statistical_selection_matches_published(spark):
    chosen = {r.series: r.method for r in fc.select_method(fc.pooled_scores(_folds(spark))).collect()}
    pub = spark.read.option("header", True).csv(reference_csv("forecast_model_selection.csv")).collect()
    assert len(pub) == 6
    assert all(chosen[r.Series] == r.Method for r in pub)


def test_ml_scores_and_selection_from_published_folds(spark):
    folds = (spark.read.schema("Series string, Product string, Origin date, Method string, AbsoluteError double, "
                               "ActualTotal double, WAPE double").option("header", True)
             .csv(reference_csv("ml_validation_folds.csv"))
             .select(F.col("Series").alias("series"), F.col("Method").alias("method"),
                     F.col("AbsoluteError").alias("absolute_error"), F.col("ActualTotal").alias("actual_total")))
    assert folds.count() == 150
    scores = fc.pooled_scores(folds)
    pub = (spark.read.option("header", True).option("inferSchema", True).csv(reference_csv("ml_validation_scores.csv"))
           .select(F.col("Series").alias("series"), F.col("Method").alias("method"),
                   F.col("ValidationWAPE").alias("pub_wape")))
    j = scores.join(pub, ["series", "method"])
    assert j.count() == 30
    assert j.agg(F.max(F.abs(F.col("validation_wape") - F.col("pub_wape")))).first()[0] < 1e-4
    sel = {r.series: r.method for r in fc.select_method(scores, fc.METHODS + ML_METHODS, None).collect()}
    pub_sel = spark.read.option("header", True).csv(reference_csv("ml_selected_methods.csv")).collect()
    assert all(sel[r.Series] == r.SelectedByValidation for r in pub_sel)


def test_holdout_comparison_from_published_weeks(spark):
    weeks = spark.read.option("header", True).option("inferSchema", True).csv(reference_csv("ml_holdout_weeks.csv"))
    assert weeks.count() == 120
    ours = weeks.groupBy("Series", "Method").agg(
        fc.wape_expr(F.sum(F.abs(F.col("ActualUnits") - F.col("ForecastUnits"))),
                     F.sum(F.abs("ActualUnits"))).alias("hw"),
        F.sum("ForecastUnits").alias("ft"))
    pub = spark.read.option("header", True).option("inferSchema", True).csv(reference_csv("ml_holdout_comparison.csv"))
    j = ours.join(pub, ["Series", "Method"])
    assert j.count() == 30
    d = j.agg(F.max(F.abs(F.col("hw") - F.col("HoldoutWAPE"))), F.max(F.abs(F.col("ft") - F.col("ForecastTotal")))).first()
    assert d[0] < 1e-3 and d[1] < 1e-3


def test_monthly_country_reconciles_with_monthly(spark):
    mc = spark.read.option("header", True).option("inferSchema", True).csv(reference_csv("monthly_country.csv"))
    m = spark.read.option("header", True).option("inferSchema", True).csv(reference_csv("monthly.csv"))
    agg = mc.groupBy("Month").agg(F.sum("Revenue").alias("r"), F.sum("Orders").alias("o"))
    j = agg.join(m, "Month")
    assert j.count() == 13
    assert j.agg(F.max(F.abs(F.col("r") - F.col("Revenue")))).first()[0] < 0.04
    assert j.where(F.col("o") != F.col("Orders")).count() == 0

"""Pooled lag-feature panel and tree-model forecasts (Spark ML).

The panel has one row per (series, anchor week, horizon): its size is
pool x weeks x 4 (about 25k rows for 121 series x 52 weeks) whatever the
size of the extract, because the series are built by distributed weekly
aggregation first.  Features are column expressions over eight lags, so
every anchor sees only weeks strictly before it.
"""

from __future__ import annotations

import datetime
import hashlib
import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.operators.forecast import HISTORY, HORIZON, lag_sum, with_lags

# Fixed values that must equal the reference.
ML_METHODS = ("random_forest", "xgboost")
FEATURE_NAMES = (
    "horizon", "lag_1_ratio", "lag_2_ratio", "lag_3_ratio", "lag_4_ratio",
    "lag_5_ratio", "lag_6_ratio", "lag_7_ratio", "lag_8_ratio",
    "mean_4_ratio", "mean_8_ratio", "std_4_ratio", "std_8_ratio",
    "recent_vs_prior_4", "positive_weeks_4", "positive_weeks_8",
    "log_recent_scale", "log_mean_8", "target_week_of_year", "target_month",
    "is_all_products",
)
SEED = 42
LABEL_CAP = 20.0
ALL_WEIGHT = 2.0
RF_PARAMS = dict(numTrees=140, maxDepth=9, minInstancesPerNode=6, featureSubsetStrategy="0.8")
GBT_PARAMS = dict(maxIter=170, maxDepth=4, stepSize=0.055, subsamplingRate=0.9,
                  featureSubsetStrategy="0.85")
# Candidate splits of a feature, and the statistics a tree level may hold.
MAX_BINS = 64
MAX_MEMORY_MB = 128
# A fit stage has a task for so many training rows, and two at least.
ROWS_PER_FIT_TASK = 8_000
FIT_PARTITIONS = 2


def _mean(ks) -> Column:
    ks = list(ks)
    return lag_sum(ks) / F.lit(float(len(ks)))


def _pop_std(ks) -> Column:
    """numpy.std (ddof 0): sqrt(mean((x - mean(x))^2)), same summation order."""
    ks = list(ks)
    m = _mean(ks)
    sq = None
    for k in ks:
        d = F.col(f"lag_{k}") - m
        sq = d * d if sq is None else sq + d * d
    return F.sqrt(sq / F.lit(float(len(ks))))


def _nonzero(ks) -> Column:
    out = None
    for k in ks:
        t = F.when(F.col(f"lag_{k}") != 0, 1.0).otherwise(0.0)
        out = t if out is None else out + t
    return out


def panel_features(weekly: DataFrame) -> DataFrame:
    """(series, anchor_week, week_idx, horizon, target_week, target_units, scale, 21 features).

    ``anchor_week`` is the forecast origin of the row: its lags are the
    eight weeks before it.  ``target_units`` comes from a lead in the same
    52-row series window (NULL beyond the grid).
    """
    w = Window.partitionBy("series").orderBy("week_start")
    base = with_lags(weekly).select(
        "*", *[F.lead("units", j).over(w).alias(f"lead_{j}") for j in range(HORIZON)])
    base = base.where(F.col("week_idx") >= HISTORY)
    recent, older, past = [4, 3, 2, 1], [8, 7, 6, 5], list(range(8, 0, -1))
    mean4, mean8 = _mean(recent), _mean(past)
    scale = F.greatest(F.lit(1.0), mean8)
    p = (base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
         .withColumn("scale", scale)
         .withColumn("target_week", F.date_add("week_start", (F.col("h") - 1) * 7))
         .withColumn("target_units", F.element_at(
             F.array(*[F.col(f"lead_{j}") for j in range(HORIZON)]), F.col("h"))))
    feats = {
        "horizon": F.col("h").cast("double"),
        **{f"lag_{k}_ratio": F.col(f"lag_{k}") / F.col("scale") for k in range(1, HISTORY + 1)},
        "mean_4_ratio": mean4 / F.col("scale"),
        "mean_8_ratio": mean8 / F.col("scale"),
        "std_4_ratio": _pop_std(recent) / F.col("scale"),
        "std_8_ratio": _pop_std(past) / F.col("scale"),
        "recent_vs_prior_4": (mean4 - _mean(older)) / F.col("scale"),
        "positive_weeks_4": _nonzero(recent) / F.lit(4.0),
        "positive_weeks_8": _nonzero(past) / F.lit(8.0),
        "log_recent_scale": F.log(F.lit(1.0) + mean4),
        "log_mean_8": F.log(F.lit(1.0) + mean8),
        "target_week_of_year": F.weekofyear("target_week").cast("double"),
        "target_month": F.month("target_week").cast("double"),
        "is_all_products": F.when(F.col("is_all"), 1.0).otherwise(0.0),
    }
    return p.select("series", F.col("week_start").alias("anchor_week"), "week_idx",
                    "target_week", F.col("target_units").cast("double").alias("target_units"),
                    "scale", *[feats[n].alias(n) for n in FEATURE_NAMES])


def training_frame(panel: DataFrame, origin: datetime.date) -> DataFrame:
    """Anchors whose whole 4-week target block precedes ``origin``:
    label = min(20, y / scale), weight 2 for the all-products series."""
    last_anchor = origin - datetime.timedelta(days=7 * HORIZON)
    t = panel.where(F.col("anchor_week") <= F.lit(last_anchor))
    return t.select("*",
                    F.least(F.lit(LABEL_CAP), F.col("target_units") / F.col("scale")).alias("label"),
                    F.when(F.col("is_all_products") == 1.0, ALL_WEIGHT).otherwise(1.0).alias("weight"))


def scoring_frame(panel: DataFrame, origin: datetime.date) -> DataFrame:
    """Features at the origin: one row per series x horizon."""
    return panel.where(F.col("anchor_week") == F.lit(origin))


def make_estimator(method: str, **overrides):
    """Spark ML stand-ins for the two tree models, reference parameters."""
    if method == "random_forest":
        params = dict(RF_PARAMS, seed=SEED, weightCol="weight", maxBins=MAX_BINS,
                      maxMemoryInMB=MAX_MEMORY_MB, **overrides)
        return RandomForestRegressor(featuresCol="features", labelCol="label", **params)
    if method == "xgboost":
        params = dict(GBT_PARAMS, seed=SEED, weightCol="weight", maxBins=MAX_BINS,
                      maxMemoryInMB=MAX_MEMORY_MB, **overrides)
        return GBTRegressor(featuresCol="features", labelCol="label", **params)
    raise KeyError(method)


def fit(train: DataFrame, method: str, **overrides):
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features")
    return Pipeline(stages=[assembler, make_estimator(method, **overrides)]).fit(train)


def rescale(scored: DataFrame) -> DataFrame:
    """forecast = max(0, predicted ratio) * scale."""
    return scored.withColumn("forecast", F.greatest(F.lit(0.0), F.col("prediction")) * F.col("scale"))


def fit_partitions(rows: int) -> int:
    """Tasks of a fit stage over a panel of ``rows``: by the rows alone, so that
    a fit does not depend on the cluster it runs on."""
    return max(FIT_PARTITIONS, math.ceil(rows / ROWS_PER_FIT_TASK))


def model_key(method: str) -> str:
    """Names the model that ``method`` fits: all that decides its predictions
    but the panel."""
    params = dict(RF_PARAMS if method == "random_forest" else GBT_PARAMS)
    said = repr((sorted(params.items()), SEED, MAX_BINS, LABEL_CAP, ALL_WEIGHT, FEATURE_NAMES, ROWS_PER_FIT_TASK))
    return hashlib.sha256(said.encode()).hexdigest()[:12]


def ml_forecasts(panel: DataFrame, origin: datetime.date, method: str,
                 train_partitions: int = FIT_PARTITIONS, **overrides) -> DataFrame:
    """Fit on the panel before ``origin`` and forecast the 4 weeks from it, for
    every series of the pool.  The training rows are dealt out by series, so
    each fit stage runs in ``train_partitions`` tasks."""
    train = training_frame(panel, origin).repartition(train_partitions, "series")
    model = fit(train, method, **overrides)
    out = rescale(model.transform(scoring_frame(panel, origin)))
    return out.select("series", F.lit(origin).alias("origin"), F.col("horizon").cast("int").alias("horizon"),
                      F.col("target_week").alias("week_start"), F.lit(method).alias("method"),
                      "prediction", "scale", "forecast")

"""The feature panel against numpy, and the tree models on a small pool."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tillpoint.operators import ml
from tillpoint.operators.forecast import ALL_SERIES
from test_forecast_methods import FIRST, frame, random_series


def plain_features(values, week, horizon, is_all):
    y = np.asarray(values[week - 8: week], float)
    scale = max(1.0, y.mean())
    target = FIRST + dt.timedelta(weeks=week + horizon - 1)
    return [horizon, *(y[::-1] / scale), y[-4:].mean() / scale, y.mean() / scale, y[-4:].std() / scale, y.std() / scale,
            (y[-4:].mean() - y[:4].mean()) / scale, (y[-4:] != 0).mean(), (y != 0).mean(), np.log1p(y[-4:].mean()),
            np.log1p(y.mean()), target.isocalendar()[1], target.month, float(is_all)]


def test_panel_matches_numpy(spark):
    series = {ALL_SERIES: random_series(3, 26), "s": random_series(8, 26), "rare": [0, 0, 0, 5] * 6 + [0, 0]}
    rows = ml.panel_features(frame(spark, series)).collect()
    assert len(rows) == 3 * (26 - 8) * 4
    for r in rows:
        want = plain_features(series[r.series], r.week_idx, int(r.horizon), r.series == ALL_SERIES)
        assert np.allclose([r[n] for n in ml.FEATURE_NAMES], want)
        at = r.week_idx + int(r.horizon) - 1
        assert r.target_units == (series[r.series][at] if at < 26 else None)


def test_training_rows_lie_before_the_origin(spark):
    origin = FIRST + dt.timedelta(weeks=20)
    panel = ml.panel_features(frame(spark, {"s": random_series(5, 26), ALL_SERIES: random_series(6, 26)}))
    rows = ml.training_frame(panel, origin).collect()
    assert len(rows) == 2 * 9 * 4  # anchors 8 to 16
    assert max(r.target_week for r in rows) < origin
    assert {(r.series == ALL_SERIES, r.weight) for r in rows} == {(True, 2.0), (False, 1.0)}
    assert all(r.label == min(20.0, r.target_units / r.scale) for r in rows)


def test_every_series_of_the_pool_is_scored_in_several_tasks(spark):
    series = {f"p{s}": random_series(s, 26) for s in range(11)} | {ALL_SERIES: random_series(50, 26)}
    panel = ml.panel_features(frame(spark, series))
    origin = FIRST + dt.timedelta(weeks=22)
    train = ml.training_frame(panel, origin).repartition(ml.FIT_PARTITIONS, "series")
    assert train.rdd.getNumPartitions() == ml.FIT_PARTITIONS > 1
    for method, few in (("random_forest", {"numTrees": 5}), ("xgboost", {"maxIter": 4})):
        out = ml.ml_forecasts(panel, origin, method, **few).collect()
        assert {r.series for r in out} == set(series) and len(out) == len(series) * 4
        assert all(r.forecast >= 0 and np.isclose(r.forecast, max(0, r.prediction) * r.scale) for r in out)


def test_estimators_set_their_split_and_memory_bounds():
    for method in ml.ML_METHODS:
        e = ml.make_estimator(method)
        assert (e.getMaxBins(), e.getMaxMemoryInMB()) == (ml.MAX_BINS, ml.MAX_MEMORY_MB)


def test_rescale_clips_negative_ratios(spark):
    df = spark.createDataFrame([(-0.5, 10.0), (1.5, 4.0)], "prediction double, scale double")
    assert [r.forecast for r in ml.rescale(df).orderBy(F.col("prediction")).collect()] == [0.0, 6.0]

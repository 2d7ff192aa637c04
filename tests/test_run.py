"""Whole runs, classifiers, intervals and other compositions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.config import ForecastConfig
from chronoloom.operators import chunks, windows
from chronoloom.plans import backtest, learners, strategies
from chronoloom.plans.run import run

T0 = datetime(2024, 1, 1)
BY = ["series_id"]


def bundle(spark, days=12):
    rng = np.random.default_rng(1)
    rows, weather, dates = [], [], []
    for i in range(24 * days):
        t = T0 + timedelta(hours=i)
        rows.append(("a", t, float(10 + 3 * np.sin(i * np.pi / 12) + rng.normal(0, 0.1)), float(i % 5), "k"))
        if i % 9:
            weather.append((t, 100.0, 3.0, 283.0, 280.0, 1010.0, 0.0))
    rows.append((*rows[5][:2], 99.0, 0.0, "k"))  # a repeated time
    del rows[30]
    for i in range(days + 2):
        dates.append((T0 + timedelta(days=i), 2 if (T0 + timedelta(days=i)).weekday() >= 5 else 1))
    future = [(T0 + timedelta(hours=24 * days + i), 90.0, 2.0, 284.0, 60.0, 1060.0, 2.5) for i in range(24)]
    return {
        "target_series": spark.createDataFrame(rows, "series_id string, time timestamp_ntz, load double, n double, kind string"),
        "date_history": spark.createDataFrame(dates, "date timestamp_ntz, date_type int"),
        "date_future": spark.createDataFrame(dates, "date timestamp_ntz, date_type int"),
        "weather_history": spark.createDataFrame(weather, "ts timestamp_ntz, rt_ssr double, rt_ws10 double, rt_tt2 double, rt_dt double, rt_ps double, rt_rain double"),
        "weather_future": spark.createDataFrame(future, "ts timestamp_ntz, pred_ssrd double, pred_ws10 double, pred_tt2 double, pred_rh double, pred_ps double, pred_rain double"),
    }


def test_run(spark):
    cfg = ForecastConfig("load", (1, 24), "h", method="USMR", numeric=("n",), categorical=("kind",), window_days=6, datetime_features=("hour", "minute", "weekday"))
    got = run(cfg, bundle(spark), windows_limit=2)
    assert got.endogenous == ["y", "n", "kind"]
    assert {"date_type", "rt_ws10", "cal_rh", "dt_hour", "dt_minute_in_day_sin"} <= set(got.exogenous)
    assert got.history.filter(F.col("y").isNull() | F.col("rt_ps").isNull()).count() == 0
    assert got.history.count() == 24 * 12
    f = got.forecast.orderBy("step").collect()
    assert len(f) == 24 and f[0].time == T0 + timedelta(days=12)
    want = [10 + 3 * np.sin((24 * 12 + i) * np.pi / 12) for i in range(24)]
    assert np.abs(np.array([r.predict_value for r in f]) - want).mean() < 1.5
    scores = {r.window: r for r in got.scores.collect()}
    assert set(scores) == {"1", "2", "mean"} and scores["mean"].mae == pytest.approx((scores["1"].mae + scores["2"].mae) / 2)


def test_run_one_step_and_errors(spark):
    cfg = ForecastConfig("load", (1, 24), "h", method="MSMD", numeric=("n",), window_days=6, forecast=False)
    got = run(cfg, {"target_series": bundle(spark)["target_series"]}, mode="one_step", windows_limit=1)
    assert got.forecast is None and got.predictions.count() == 24
    with pytest.raises(ValueError):
        run(cfg, {}, mode="other")


def test_chunks_equal_whole(spark):
    rows = [("a", T0 + timedelta(hours=i), float((i * 37) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, y double")
    whole = windows.rolling(df, BY, ["time"], ["y"], [12], ["mean", "max"])
    cut = chunks.own_rows(windows.rolling(chunks.chunked(df, "time", 3 * 86400, 13 * 3600), [*BY, "chunk"], ["time"], ["y"], [12], ["mean", "max"]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.select(whole.columns).collect()))
    with pytest.raises(ValueError):
        chunks.chunked(df, "time", 10, 20)


def test_interval_and_classifier(spark):
    f = spark.createDataFrame([(1, 5.0)], "step int, predict_value double")
    s = spark.createDataFrame([(1.0,), (3.0,)], "mae double")
    r = strategies.interval(f, s).first()
    assert (r.low, r.high) == pytest.approx((5 - 1.96, 5 + 1.96))
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(float(i), float(i > 10)) for i in range(20)], "x double, label double")
    wide = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    assert learners.classifier("logistic").fit(wide).transform(wide).filter("prediction = label").count() >= 18
    with pytest.raises(ValueError):
        learners.classifier("ada")


def test_refit_uses_the_past_only(spark):
    rows = [("a", T0 + timedelta(hours=i), float(0.5**i)) for i in range(12)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, y double")
    got = [r.predict_value for r in backtest.walk_forward_refit(df, BY, "y", 1, 4).orderBy("time").collect()]
    assert got[:4] == [None] * 4 or all(np.isnan(v) for v in got[:4])
    assert got[6] == pytest.approx(0.5**6, abs=1e-3)


def test_detectors_and_learners_of_other_families(spark):
    rng = np.random.default_rng(2)
    rows = [("a", T0 + timedelta(hours=i), float(v), float(2 * v + rng.normal(0, 0.1))) for i, v in enumerate(rng.normal(0, 1, 80))]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, a double, b double")
    model = learners.create("rf", numTrees=5, maxDepth=4).fit(df, ["a"], ["b"])
    assert model.predict(df).select(F.corr("b", "b_hat")).first()[0] > 0.9
    assert list(model.importance()) == ["a"]

"""Hand-checkable fixtures and properties."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.config import ForecastConfig, freq_minutes, from_yaml, plan_run
from chronoloom.operators import align, anomaly, encode, joins, reshape, smooth, windows
from chronoloom.plans import backtest, deterministic, ensemble, learners, statistical, strategies

T0 = datetime(2024, 1, 1)


def series(spark, values, sid="s", **extra):
    rows = [(sid, T0 + timedelta(hours=i), None if v is None else float(v), *[e[i] for e in extra.values()]) for i, v in enumerate(values)]
    kinds = "".join(f", {k} double" for k in extra)
    return spark.createDataFrame(rows, f"sid string, time timestamp_ntz, y double{kinds}")


def column(df, name):
    return [r[0] for r in df.orderBy("sid", "time").select(name).collect()]


BY, ORDER = ["sid"], ["time"]


def test_lags_and_shifts(spark):
    df = windows.targets(windows.lags(series(spark, range(1, 11)), BY, ORDER, ["y"], [1, 3]), BY, ORDER, "y", 2)
    assert column(df, "y_lag_3") == [None] * 3 + [float(i) for i in range(1, 8)]
    assert column(df, "y_shift_0") == [float(i) for i in range(1, 11)]
    assert column(df, "y_shift_1")[-1] is None


def test_interpolation(spark):
    df = align.interpolate(series(spark, [None, None, 3, None, None, 9, 1, None, 4, None]), BY, ORDER, ["y"])
    assert column(df, "y") == [3, 3, 3, 5, 7, 9, 1, 2.5, 4, 4]


def test_interpolation_of_an_empty_series(spark):
    assert column(align.interpolate(series(spark, [None, None]), BY, ORDER, ["y"]), "y") == [None, None]
    assert align.interpolate(series(spark, []), BY, ORDER, ["y"]).count() == 0


def test_rolling(spark):
    df = windows.rolling(series(spark, [1, 3, 2, 5, 4, 8, 7]), BY, ORDER, ["y"], [4])
    assert column(df, "y_rolling_mean_4") == [1, 2, 2, 2.75, 3.5, 4.75, 6]
    assert column(df, "y_rolling_median_4") == [1, 2, 2, 2.5, 3.5, 4.5, 6]
    assert column(df, "y_rolling_skew_4")[3] == pytest.approx(0.752837, abs=1e-6)
    assert column(df, "y_rolling_kurt_4")[3:] == pytest.approx([0.342857, -1.2, 0.928, -3.3], abs=1e-6)


def test_rolling_against_pandas(spark):
    y = np.random.default_rng(1).normal(10, 3, 60)
    df = windows.rolling(series(spark, y), BY, ORDER, ["y"], [7])
    r = pd.Series(y).rolling(7, min_periods=1)
    for stat in ("mean", "std", "min", "max", "median", "skew", "kurt"):
        want = [None if np.isnan(v) else v for v in getattr(r, stat)()]
        assert column(df, f"y_rolling_{stat}_7") == pytest.approx(want, abs=1e-8)


def test_wide_mean_equals_frame(spark):
    df = series(spark, [1, None, 3, 4, None, 6, 7])
    a = column(windows.wide_mean(df, BY, ORDER, "y", 3), "y_rolling_mean_3")
    assert a == column(windows.rolling(df, BY, ORDER, ["y"], [3], ["mean"]), "y_rolling_mean_3")


def test_pct_change_pads_and_never_divides_by_zero(spark):
    assert column(windows.pct_changes(series(spark, [0, 1, None, 2]), BY, ORDER, ["y"], [1]), "y_pct_change_1") == [None, None, 0, 1]


def test_time_since(spark):
    df = windows.time_since(series(spark, [1, 3, 2, 0, 4, 1]), BY, ORDER, "y")
    assert column(df, "y_time_since_peak") == [0, 1, 1, 2, 3, 1]
    assert column(df, "y_time_since_trough") == [0, 1, 2, 3, 1, 2]


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    got = {r.c: r.c_code for r in encode.encode(df, encode.fit_codes(df, "c"), "c").collect()}
    assert got == {"b": 1, "a": 0, None: -1}


def test_scaler_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    for kind, want in (("standard", [-1, 1]), ("minmax", [0, 1])):
        got = encode.scale(df, encode.fit_scaler(df, ["a", "b"], kind), ["a", "b"]).orderBy("a").collect()
        assert [r.a for r in got] == want and [r.b for r in got] == [0, 0]


def test_keep_last_and_outliers(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "k int, o int, v double")
    assert sorted(r.v for r in align.keep_last(df, ["k"], ["o"]).collect()) == [6.0, 7.0]
    df = series(spark, [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 100])
    assert align.remove_outliers(df, BY, "y", 3.0).count() == 10


def test_as_of(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in (0, 2, 5)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0 + timedelta(hours=h), float(h)) for h in (1, 2, 4)], "k string, t timestamp_ntz, v double")
    got = [r.v for r in joins.as_of(left, right, ["k"], "t", ["v"]).orderBy("t").collect()]
    assert got == [None, 2.0, 4.0]


def test_pairs_without_counterpart(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 3.0)], "d int, id int, v double")
    pairs = spark.createDataFrame([(0, 1), (1, -1)], "i int, j int")
    assert sorted(r.spread for r in joins.gather_pairs(df, pairs, "d", "id", "v").collect()) == [2.0, 3.0]


def test_dbscan_fixture(spark):
    pts = [[1, 2], [2, 2], [2, 3], [8, 7], [8, 8], [25, 80]]
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "sid string, k int, a double, b double")
    got = [r.cluster for r in anomaly.dbscan(df, BY, "k", ["a", "b"], 3, 2).orderBy("k").collect()]
    assert got == [0, 0, 0, 1, 1, -1]


def test_grubbs():
    assert anomaly.grubbs_outliers([8, 9, 10, 50, 9], side="max") == [3]
    assert anomaly.grubbs_outliers([8, 9, 10, 1, 9], side="min") == [3]
    assert anomaly.student_t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert anomaly.student_t_quantile(0.95, 3) == pytest.approx(2.353363, abs=1e-5)


def test_detectors_find_a_spike(spark):
    y = [float(10 + i % 3) for i in range(60)]
    y[50] = 100.0
    df = series(spark, y)
    for got in (anomaly.n_sigma(df, BY, "y"), anomaly.mean_band(df, BY, ORDER, "y", 12), anomaly.exponential_band(df, BY, ORDER, "y", 12), anomaly.shifting_band(df, BY, "time", "y", 12), anomaly.box_outliers(df, BY, ["y"]), anomaly.seasonal_band(df, BY, ORDER, "y", 6), anomaly.isolation_forest(df, BY, ["y"], trees=20, contamination=0.02)):
        assert (T0 + timedelta(hours=50)) in [r.time for r in got.filter("is_anomaly").collect()]
    for kind in ("lof", "cof", "sos"):
        s = column(anomaly.density(df, BY, "time", "y", kind, 10), "score")
        assert int(np.argmax(s)) == 50


def test_lof_of_tiny_series(spark):
    assert column(anomaly.density(series(spark, [1, 2]), BY, "time", "y", "lof", 5), "score") == [1.0, 1.0]


def test_smoothers(spark):
    y = [1, 5, 2, 8, 3, 9, 4]
    assert column(smooth.moving_average(series(spark, y), BY, ORDER, "y", 3), "smooth") == pytest.approx([1, 8 / 3, 5, 13 / 3, 20 / 3, 16 / 3, 4])
    assert column(smooth.moving_average(series(spark, y), BY, ORDER, "y", 9), "smooth") == y
    assert column(smooth.moving_median(series(spark, y), BY, ORDER, "y", 3, "left"), "smooth") == [2, 5, 3, 8, 8, 8, 8]
    assert column(smooth.moving_median(series(spark, y), BY, ORDER, "y", 3, "right"), "smooth") == [2, 2, 2, 2, 5, 3, 8]
    assert column(smooth.on_off(series(spark, y), BY, ORDER, "y", 1.5, 3), "smooth") == [0, 0, 1, 1, 1, 1, 1]
    line = [float(i) for i in range(30)]
    assert column(smooth.lowess(series(spark, line), BY, "time", "y", 0.3), "smooth") == pytest.approx(line, abs=1e-6)
    got = column(smooth.kalman(series(spark, [*line[:10], None, *line[11:]]), BY, "time", "y"), "smooth")
    assert got[10] == pytest.approx(10, abs=0.3)


def test_linear_var_continues_a_line(spark):
    rows = [("s", T0 + timedelta(hours=i), float(i), float(i + 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "sid string, time timestamp_ntz, x double, y double")
    _, got = statistical.linear_var(df, BY, ["x", "y"], [0, 1, 2], 3)
    r = got.first()
    assert [r.x_next_1, r.x_next_2, r.x_next_3] == pytest.approx([10, 11, 12])
    assert [r.y_next_1, r.y_next_3] == pytest.approx([15, 17])


def test_recursions_agree_with_a_loop(spark):
    rng = np.random.default_rng(3)
    y = list(np.cumsum(rng.normal(0, 1, 80)))
    x = [float(np.sin(i / 3)) for i in range(90)]
    hist = series(spark, y, x=x[:80])
    fut = series(spark, [None] * 90, x=x).filter(F.col("time") >= T0 + timedelta(hours=80)).drop("y")
    got = [r.predict_value for r in strategies.forecast("USMR", hist, fut, BY, "y", [], ["x"], [1, 2, 5], 10).orderBy("step").collect()]
    a = np.array([[1, *[y[i - k] for k in (1, 2, 5)], x[i]] for i in range(5, 80)])
    w = np.linalg.lstsq(a, np.array(y[5:]), rcond=None)[0]
    want = strategies.recursive_kernel(lambda v: w[0] + w[1:] @ v, y, np.array(x[80:])[:, None], [1, 2, 5])
    assert got == pytest.approx(want, abs=1e-6)
    assert [r.predict_value for r in strategies.forecast("USMDR", hist, fut, BY, "y", [], ["x"], [1, 2, 5], 10).orderBy("step").collect()] == pytest.approx(want, abs=1e-6)


def test_all_strategies_give_the_horizon(spark):
    rng = np.random.default_rng(4)
    n = [float(v) for v in rng.normal(5, 1, 60)]
    hist = series(spark, [float(v) for v in rng.normal(0, 1, 60)], n=n, x=[float(i % 7) for i in range(60)])
    fut = series(spark, [None] * 70, x=[float(i % 7) for i in range(70)]).filter(F.col("time") >= T0 + timedelta(hours=60)).drop("y")
    for m in strategies.METHODS:
        got = strategies.forecast(m, hist, fut, BY, "y", ["n"], ["x", "absent"], [1, 2], 6).orderBy("step").collect()
        assert [r.step for r in got] == [1, 2, 3, 4, 5, 6] and all(np.isfinite(r.predict_value) for r in got)
    with pytest.raises(ValueError, match="USMDO"):
        strategies.forecast("NO", hist, fut, BY, "y", [], [], [1], 2)


def test_recursion_before_the_start():
    with pytest.raises(ValueError, match="lag 5"):
        strategies.recursive_kernel(lambda v: v.sum(), [1.0], np.zeros((2, 0)), [5])
    assert strategies.recursive_kernel(lambda v: v[0] + 1, [1.0], np.zeros((2, 0)), [1], fill=0.0) == [2.0, 3.0]
    assert strategies.rolled_vector(lambda v: v[-1] + 1, [1, 2, 3], 3) == [4, 5, 6]


def test_windows_never_overlap(spark):
    df = series(spark, range(100))
    for b in (backtest.window_bounds(df, BY, 40, 10), backtest.fold_bounds(df, BY, 4)):
        rows = b.collect()
        assert rows
        for r in rows:
            assert 0 <= r.train_start < r.train_end <= r.test_start <= r.test_end < 100
    assert backtest.window_bounds(series(spark, range(5)), BY, 40, 10).count() == 0


def test_panel_is_the_union_of_series(spark):
    a, b = series(spark, range(50), "a"), series(spark, range(50, 0, -1), "b")
    both = windows.rolling(a.union(b), BY, ORDER, ["y"], [5], ["mean", "std"])
    alone = windows.rolling(a, BY, ORDER, ["y"], [5], ["mean", "std"]).union(windows.rolling(b, BY, ORDER, ["y"], [5], ["mean", "std"]))
    assert column(both, "y_rolling_std_5") == column(alone, "y_rolling_std_5")


def test_difference_sums_telescope(spark):
    y = [3, 1, 4, 1, 5, 9, 2, 6]
    d = column(windows.diffs(series(spark, y), BY, ORDER, ["y"], [1]), "y_diff_1")
    assert sum(v for v in d if v is not None) == y[-1] - y[0]


def test_learner_registry(spark):
    with pytest.raises(ValueError, match="ridge"):
        learners.create("nope")
    assert "lgb" in learners.list_models() and learners.create("LightGBM").params()["objective"] == "mae"
    df = series(spark, [2 * i + 1 for i in range(20)], x=[float(i) for i in range(20)])
    m = learners.create("ols").fit(df, ["x"], ["y"])
    assert m.weights.ravel().tolist() == pytest.approx([1, 2], abs=1e-8)


def test_model_round_trip(spark, tmp_path):
    df = series(spark, [2 * i + 1 for i in range(20)], x=[float(i) for i in range(20)])
    m = learners.create("ols").fit(df, ["x"], ["y"])
    learners.save(m, spark, str(tmp_path / "m"))
    assert np.allclose(learners.load(spark, str(tmp_path / "m")).weights, m.weights)


def test_simplex_weights(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(0, 1, (3, 200))
    y = 0.7 * a + 0.3 * b
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, strict=True)], "a double, b double, c double, y double")
    assert ensemble.simplex_weights(df, ["a", "b", "c"], "y") == pytest.approx([0.7, 0.3, 0.0], abs=1e-4)


def test_statistical_kernels():
    line = np.arange(40.0)
    assert statistical.theta_kernel(line, 3) == pytest.approx([39.5 + 0.5 * i for i in range(3)], abs=0.1)
    assert statistical.ar_kernel(np.sin(np.arange(100) / 5), 5)[0] == pytest.approx(np.sin(np.arange(100, 105) / 5), abs=1e-4)
    assert statistical.croston_kernel(np.array([0, 2, 0, 2, 0, 2.0]), 2) == pytest.approx([1, 1])
    season = np.tile([1.0, 5, 3, 7], 12)
    assert statistical.holt_winters_kernel(season, 4, 0.2, 0.1, 0.1, 4)[0] == pytest.approx([1, 5, 3, 7], abs=1e-6)
    assert statistical.stationary([0.5]) and not statistical.stationary([1.2])
    walk = np.cumsum(np.random.default_rng(1).normal(0, 1, 400))
    assert statistical.differences_needed(walk) >= 1
    assert len(statistical.arima_kernel(walk, 6)[0]) == 6
    assert deterministic.pacf([0.5, 0.25, 0.125]) == pytest.approx([0.5, 0, 0])


def test_ses_and_holt(spark):
    got = statistical.ses(series(spark, [1, 2, 3]), BY, "y", [0.5]).first()
    assert (got.level, got.mae) == (2.25, 1.25)
    got = statistical.holt(series(spark, range(10)), BY, "y", 0.5, 0.5).first()
    assert (got.level, got.trend, got.mae) == pytest.approx((9, 1, 0))


def test_config():
    cfg = ForecastConfig("load", (1, 2))
    p = plan_run(cfg, datetime(2024, 2, 1, 10, 30))
    assert (p.n_per_day, p.horizon, p.window_len, p.n_windows) == (288, 288, 4320, 15)
    assert p.start == datetime(2024, 1, 1) and p.now == datetime(2024, 2, 1, 10)
    assert [freq_minutes(f) for f in ("5min", "h", "2D")] == [5, 60, 2880]
    assert from_yaml("target: y\nlags: [1, 7]\nfreq: h").lags == (1, 7)
    for bad in (lambda: freq_minutes("x"), lambda: ForecastConfig("y", (0,)), lambda: ForecastConfig("y", (1,), predict_days=0)):
        with pytest.raises(ValueError):
            bad()


def test_feature_groups_are_disjoint():
    g = encode.feature_groups(["y_lag_1", "rt_tt2", "dt_hour", "k", "v", "rt_ws10_lag_2"], ["k"])
    assert g == {"lag": ["y_lag_1", "rt_ws10_lag_2"], "weather": ["rt_tt2"], "datetime": ["dt_hour"], "categorical": ["k"], "other": ["v"]}


def test_reshapes(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, 5.0)], "k int, a double, b double")
    assert [r.best_model for r in reshape.best_model(df, ["a", "b"]).orderBy("k").collect()] == ["b", "a"]
    long = reshape.unpivot(df, ["k"], ["a", "b"])
    back = reshape.pivot(long, ["k"], "name", "value", ["a", "b"]).orderBy("k").collect()
    assert [(r.a, r.b) for r in back] == [(3.0, 2.0), (1.0, 5.0)]

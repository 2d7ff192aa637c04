"""The seven strategies inside windows against plain loops, and one fit rule for backtest and forecast."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.config import ForecastConfig
from chronoloom.plans import backtest as bt
from chronoloom.plans.run import run
from chronoloom.plans.strategies import METHODS

T0 = datetime(2024, 1, 1)
STEPS = [1, 3]


def ridge(x, y, penalty=1e-6):
    x, y = np.array(x), np.array(y)
    m, s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w = np.linalg.lstsq(np.vstack((z, np.sqrt(penalty) * np.eye(z.shape[1]))), np.concatenate((y, np.zeros(z.shape[1]))), rcond=None)[0]
    return lambda v: float(w[0] + w[1:] @ ((np.array(v) - m) / s))


def plain(method, y, x, new):
    """One scalar model a step and column, one value at a time."""
    n, h, cols = len(y), len(new), range(y.shape[1])
    row = lambda held, t, ex: [held[t - s][c] for c in cols for s in STEPS] + list(ex)
    if method == "USMDO":
        f = ridge(x, y[:, 0])
        return [f(v) for v in new]
    if method in ("USMD", "MSMD"):
        out = []
        for j in range(h):
            at = range(max(STEPS), n - h + 1)
            out.append(ridge([row(y, t, x[t]) for t in at], [y[t + j, 0] for t in at])(row(y, n, new[0])))
        return out
    fits = {c: ridge([row(y, t, x[t]) for t in range(max(STEPS), n)], y[max(STEPS) :, c]) for c in (cols if method == "MSMR" else [0])}
    held = [list(v) for v in y]
    for t in range(n, n + h):
        held.append([fits[c](row(held, t, new[t - n])) if c in fits else held[-1][c] for c in cols])
    return [v[0] for v in held[n:]]


@pytest.mark.parametrize("method", METHODS)
def test_kernels(method):
    r = np.random.default_rng(3)
    y = np.cumsum(r.normal(size=(60, 1 if method.startswith("U") else 2)), axis=0)
    x, new = r.normal(size=(60, 2)), r.normal(size=(5, 2))
    assert np.allclose(bt.method_kernel(method, y, x, new, STEPS), plain(method, y, x, new), atol=1e-6)
    assert np.isnan(bt.method_kernel(method, y[:6], x[:6], new, STEPS)).all() or method == "USMDO"
    assert len(bt.method_kernel(method, y, x, new[:0], STEPS)) == 0


def series(spark, hours=240):
    r = np.random.default_rng(4)
    rows = []
    for sid in ("a", "b"):
        y = 10 + 3 * np.sin(np.arange(hours) * np.pi / 12) + r.normal(0, 0.3, hours)
        rows += [(sid, T0 + timedelta(hours=i), float(y[i]) if i % 50 else None, float(np.cos(i / 5) + r.normal(0, 0.1))) for i in range(hours)]
    rows += [("short", T0 + timedelta(hours=i), 1.0, 1.0) for i in range(6)]
    return spark.createDataFrame(rows, "series_id string, time timestamp_ntz, load double, n double")


def test_scores_are_of_the_method(spark):
    data = {"target_series": series(spark)}
    seen = {}
    for method in METHODS:
        cfg = ForecastConfig("load", (1, 3, 24), "h", method=method, numeric=("n",), window_days=6, datetime_features=("hour",))
        got = run(cfg, data, windows_limit=2)
        seen[method] = {(r.series_id, r.window): round(r.mae, 9) for r in got.scores.collect()}
        # What the windows' rule gives on the whole history is the forecast.
        ahead = {r.step: r.predict_value for r in got.forecast.filter("series_id = 'a'").collect()}
        h = got.history.filter("series_id = 'a'").orderBy("time").toPandas()
        own = ["y"] if method.startswith("U") else ["y", "n"]
        future = np.array([[float((T0 + timedelta(hours=240 + k)).hour)] for k in range(24)])
        assert np.allclose([ahead[k + 1] for k in range(24)], bt.method_kernel(method, h[own].to_numpy(float), h[["dt_hour"]].to_numpy(float), future, [1, 3, 24]))
        assert {w for _, w in seen[method]} == {"1", "2", "mean"} and ("short", "1") not in seen[method]
        short = got.forecast.filter("series_id = 'short'")
        assert short.count() == 24 and (method == "USMDO" or short.filter("predict_value IS NOT NULL").count() == 0)
    assert seen["USMR"] == seen["USMDR"]
    different = [seen[m] for m in ("USMDO", "USMD", "USMR", "MSMD", "MSMR", "MSMDR")]
    assert all(a != b for i, a in enumerate(different) for b in different[:i])


def test_nothing_of_the_test_part_is_seen(spark):
    df = series(spark).na.drop().withColumn("y", F.col("load"))
    bounds = bt.window_bounds(df, ["series_id"], 120, 24, 1)
    spoilt = df.join(bounds, "series_id").withColumn("_i", F.row_number().over(bt.over(["series_id"], ["time"])) - 1)
    spoilt = spoilt.withColumn("y", F.when(F.col("_i") >= F.col("test_start"), 1e6).otherwise(F.col("y"))).withColumn("n", F.when(F.col("_i") >= F.col("test_start"), -1e6).otherwise(F.col("n")))
    for method in ("USMD", "MSMR", "MSMDR"):
        a, b = (sorted((r.series_id, r.step, r.predict_value) for r in bt.backtest_method(x.select("series_id", "time", "y", "n"), bounds, ["series_id"], "y", ["n"], [], [1, 24], method).collect()) for x in (df, spoilt))
        assert len(a) == 48 and a == b
    assert bt.backtest_method(df.limit(0), bounds.limit(0), ["series_id"], "y", ["n"], [], [1], "MSMR").count() == 0


def test_a_constant_column_tells_nothing():
    r = np.random.default_rng(5)
    y = np.cumsum(r.normal(size=(50, 1)), axis=0)
    x = np.full((50, 1), 0.1 + 0.2)
    for method in ("USMDO", "USMD", "USMR"):
        far = bt.method_kernel(method, y, x, np.full((4, 1), 77.0), STEPS)
        assert np.allclose(far, bt.method_kernel(method, y, x, x[:4], STEPS), atol=1e-3)

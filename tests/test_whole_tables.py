"""Operators that read every row, against plain versions over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import aggregates, anomaly, joins
from chronoloom.plans import backtest, statistical


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())


def test_kendall_over_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for sid, n, values in (("a", 500, 1000), ("b", 333, 4), ("c", 2, 9)):
        x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
        if sid == "c":
            x, y = np.array([1.0, 2.0]), np.array([3.0, 1.0])
        want[sid] = tau_b(x, y)
        rows += [(sid, float(p), float(q)) for p, q in zip(x, y, strict=True)]
    rows += [("d", 1.0, 2.0), ("d", 1.0, 3.0), ("a", None, 1.0)]
    got = {r["sid"]: r["tau"] for r in aggregates.kendall(spark.createDataFrame(rows, "sid string, x double, y double"), ["sid"], "x", "y").collect()}
    assert got.pop("d") is None
    assert got == pytest.approx(want)
    assert aggregates.kendall(spark.createDataFrame([], "sid string, x double, y double"), ["sid"], "x", "y").count() == 0


def lof(x, k):
    d = np.abs(x[:, None] - x)
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1)[:, :k]
    own = np.take_along_axis(d, at, 1)
    lrd = 1 / np.maximum(own[at, -1], own).mean(1)
    return lrd[at].mean(1) / lrd


def test_lof_from_sorted_neighbours(spark):
    x = np.random.default_rng(2).standard_normal(300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "sid string, time int, y double")
    got = {r["time"]: r["score"] for r in anomaly.density(df, ["sid"], "time", "y", "lof", 7).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(lof(x, 7))


@pytest.mark.parametrize("sizes", [(40, 40), (50, 7), (7, 50), (1, 5)])
def test_kernel_sums_use_every_row_of_both_sides(spark, sizes):
    rng = np.random.default_rng(3)
    sides = [rng.standard_normal((n, 3)) + i for i, n in enumerate(sizes)]
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "id long, v array<double>") for s in sides]
    got = joins.kernel_sums(*frames, "id", "v", parts=4).first()
    x, y = (s[sorted(range(len(s)), key=lambda i: (i % 4, i))] for s in sides)
    every = np.concatenate((x, y))
    d = ((every[:, None] - every) ** 2).sum(2)
    width = d.sum() / (len(every) * (len(every) - 1))
    k = lambda a, b: sum(np.exp(-((a - b) ** 2).sum() / (width * 2.0 ** (i - 2))) for i in range(5))
    n, m, most = len(x), len(y), max(sizes)
    want = [np.mean([k(s[i], s[(i + 1) % len(s)]) for i in range(len(s))]) for s in (x, y)]
    want.append(np.mean([(k(x[i % n], y[(i + 1) % m]) + k(x[(i + 1) % n], y[i % m])) / 2 for i in range(most)]))
    assert got["pairs"] == most
    assert [got["k_source"], got["k_target"], got["k_between"]] == pytest.approx(want)
    assert got["mmd"] == pytest.approx(want[0] + want[1] - 2 * want[2])


def test_bayes_var_centres_on_least_squares_over_all_rows(spark):
    rng = np.random.default_rng(4)
    y = np.zeros((6200, 2))
    for i in range(1, len(y)):
        y[i] = [1.0, -0.5] + y[i - 1] @ np.array([[0.6, 0.1], [-0.2, 0.5]]) + rng.standard_normal(2) * 0.1
    rows = [(s, i, *(float(v) for v in r)) for s in ("a", "b") for i, r in enumerate(y[: 6200 if s == "a" else 40])] + [("short", 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "sid string, time int, p double, q double")
    got = {(r["sid"], r["column"]): r for r in statistical.bayes_var(df, ["sid"], ["p", "q"], horizon=1).collect()}
    assert sorted({k[0] for k in got}) == ["a", "b"]
    for sid, n in (("a", 6200), ("b", 40)):
        x = np.column_stack([np.ones(n - 2), y[1 : n - 1], y[: n - 2]])
        w = np.linalg.solve(x.T @ x + 0.1 * np.eye(5), x.T @ y[2:n])
        want = np.concatenate(([1.0], y[n - 1], y[n - 2])) @ w
        for j, c in enumerate(("p", "q")):
            r = got[sid, c]
            assert r["mean"] == pytest.approx(want[j], abs=0.03)
            assert r["low"] < want[j] < r["high"] and 0.1 < r["high"] - r["low"] < 0.8


def test_rows_meet_exactly_their_windows(spark):
    df = spark.createDataFrame([(s, i, float(i)) for s, n in (("a", 1500), ("b", 700)) for i in range(n)], "sid string, time int, y double")
    bounds = backtest.window_bounds(df, ["sid"], 336, 24)
    parts = backtest.in_windows(df, bounds, ["sid"]).groupBy("sid", "window", "part").agg(F.count("*").alias("n"), F.min("time").alias("a"))
    got = {(r["sid"], r["window"], r["part"]): (r["n"], r["a"]) for r in parts.collect()}
    want = {}
    for r in bounds.collect():
        want[r["sid"], r["window"], "train"] = (r["train_end"] - r["train_start"], r["train_start"])
        want[r["sid"], r["window"], "test"] = (24, r["test_start"])
    assert got == want and len({k[1] for k in want if k[0] == "a"}) == (1500 - 312) // 24

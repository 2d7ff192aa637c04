"""Vector autoregression on log differences against a plain fit of each order."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.plans import vectors

T0 = datetime(2024, 1, 1)
SCHEMA = "sid string, part int, time timestamp_ntz, a double, b double"


def path(seed, n, w):
    r = np.random.default_rng(seed)
    d = [r.normal(0, 0.01, 2) for _ in range(2)]
    for _ in range(n):
        d.append(w[0] @ d[-1] + w[1] @ d[-2] + r.normal(0, 0.01, 2))
    return np.exp(np.cumsum(d, axis=0)) * 50


def plain(levels, most, steps):
    """(order, criterion, forecasts), each order by least squares of its own."""
    d = np.diff(np.log(levels), axis=0)
    best = None
    for p in range(1, most + 1):
        x = np.array([[1.0, *np.concatenate([d[t - s] for s in range(1, p + 1)])] for t in range(most, len(d))])
        w, *_ = np.linalg.lstsq(x, d[most:], rcond=None)
        e = d[most:] - x @ w
        aic = math.log(np.linalg.det(e.T @ e / len(e))) + 2 * w.size / len(e)
        if best is None or aic < best[1] - 1e-9:
            best = (p, aic, w)
    p, aic, w = best
    held, out = list(d), np.log(levels[-1])
    ahead = []
    for _ in range(steps):
        held.append(np.r_[1.0, np.concatenate([held[-s] for s in range(1, p + 1)])] @ w)
        out = out + held[-1]
        ahead.append(np.exp(out))
    return p, aic, np.array(ahead)


@pytest.mark.parametrize("parts", [1, 7])
def test_orders_and_forecasts(spark, parts):
    two = [np.array([[0.1, 0.0], [0.2, 0.0]]), np.array([[0.6, 0.0], [0.0, -0.5]])]
    one = [np.array([[0.7, 0.1], [0.0, 0.4]]), np.zeros((2, 2))]
    levels = {("x", 1): path(1, 400, two), ("x", None): path(2, 300, one), (None, 1): path(3, 120, one)}
    rows = [(*k, T0 + timedelta(hours=i), *map(float, v)) for k, x in levels.items() for i, v in enumerate(x)]
    rows += [("short", 1, T0 + timedelta(hours=i), 1.0 + i, 2.0 + i * i) for i in range(6)]
    rows += [("flat", 1, T0 + timedelta(hours=i), 1.0, 2.0) for i in range(40)]
    rows += [("ends", 1, T0 + timedelta(hours=i), 1.0 + i % 3, None if i == 39 else 2.0 + i % 5) for i in range(40)]
    got = vectors.var_log(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["sid", "part"], ["a", "b"], 3, 4).collect()
    assert {(r.sid, r.part) for r in got} == set(levels)
    for k, x in levels.items():
        p, aic, ahead = plain(x, 3, 4)
        own = sorted((r for r in got if (r.sid, r.part) == k), key=lambda r: r.step)
        assert [r.step for r in own] == [1, 2, 3, 4] and {r.order for r in own} == {p} and own[0].aic == pytest.approx(aic)
        assert np.allclose([[r.a, r.b] for r in own], ahead)
    assert {r.order for r in got if (r.sid, r.part) == ("x", 1)} == {2}


def test_gaps_train_nothing(spark):
    x = path(5, 200, [np.array([[0.5, 0.1], [0.0, 0.4]]), np.zeros((2, 2))])
    holes = x.copy()
    holes[50, 0], holes[90, 1] = 0.0, -3.0
    rows = [("x", 1, T0 + timedelta(hours=i), *map(float, v)) for i, v in enumerate(holes)]
    got = vectors.var_log(spark.createDataFrame(rows, SCHEMA), ["sid", "part"], ["a", "b"], 1, 1).first()
    d = np.diff(np.log(np.where(holes > 0, holes, np.nan)), axis=0)
    at = [t for t in range(1, len(d)) if not np.isnan(d[t - 1 : t + 1]).any()]
    w, *_ = np.linalg.lstsq(np.c_[np.ones(len(at)), d[[t - 1 for t in at]]], d[at], rcond=None)
    assert np.allclose([got.a, got.b], holes[-1] * np.exp(np.r_[1.0, d[-1]] @ w))
    assert vectors.var_log(spark.createDataFrame([], SCHEMA), ["sid", "part"], ["a", "b"]).count() == 0

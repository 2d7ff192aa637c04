"""Searches over several parameters against scores worked out trial by trial."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.plans import backtest as bt
from chronoloom.plans import tuning
from chronoloom.plans.trees import Boosting, boost_arrays
from tests.test_trees import arrays, plain_boosting, table

T0 = datetime(2024, 1, 1)
BY = ["sid"]


@pytest.mark.parametrize("learner", [Boosting(rounds=5, rate=0.3, leaves=6, bins=8, rows=3, l1=0.2, l2=0.5), Boosting(rounds=2, leaves=4, depth=2, bins=16, rows=1)])
def test_boosting_inside_a_task(learner):
    x, y, _ = arrays(table(160, 3), [3, 4])
    at = [k / learner.bins for k in range(1, learner.bins)] + [1.0]
    edges = [np.unique(np.quantile(c[~np.isnan(c)], at, method="inverted_cdf"))[:-1] for c in x.T]
    codes = np.column_stack([np.where(np.isnan(c), 0, np.searchsorted(e, c) + 1) for c, e in zip(x.T, edges, strict=True)])
    assert np.allclose(boost_arrays(x, y, x, learner), plain_boosting(x, y, learner, codes)[0])
    assert np.allclose(boost_arrays(x[:1], y[:1], x[:3], learner), y[0])


def series(spark):
    r = np.random.default_rng(1)
    rows = [(s, T0 + timedelta(hours=i), float(3 * (i % 7 > 3) + r.normal(0, 0.3)), float(i % 7), float(r.normal()) if i % 40 else None) for s in ("a", "b") for i in range(160)]
    return spark.createDataFrame(rows, "sid string, time timestamp_ntz, y double, p double, q double")


def folds(df, rounds, params):
    """The mean error over all folds, from plain frames."""
    out = []
    for s in ("a", "b"):
        h = df.filter(df.sid == s).orderBy("time").toPandas()
        k = len(h) // 4
        for w in range(1, 4):
            start = len(h) - k * (4 - w)
            train, test = h[:start].dropna(), h[start : start + k].dropna()
            p = boost_arrays(train[["p", "q"]].to_numpy(float), train[["y"]].to_numpy(float), test[["p", "q"]].to_numpy(float), Boosting(rounds=rounds, **params))[:, 0]
            out.append(np.abs(p - test["y"]).mean())
    return float(np.mean(out))


def test_halving(spark):
    df = series(spark)
    bounds = bt.fold_bounds(df, BY, 3)
    got = {r.trial: r for r in tuning.halving_search(df, bounds, BY, "y", ["p", "q"], trials=6, rungs=(2, 6)).collect()}
    assert len(got) == 6 and sorted(r.rung for r in got.values()) == [0] * 4 + [1] * 2
    for r in got.values():
        params = json.loads(r.params)
        assert set(params) == set(tuning.GRID) and all(params[k] in tuning.GRID[k].values for k in params)
        assert r.mae == pytest.approx(folds(df, (2, 6)[r.rung], params))
    first = {k: folds(df, 2, json.loads(r.params)) for k, r in got.items()}
    assert {k for k, r in got.items() if r.rung} == set(sorted(first, key=lambda k: (round(first[k], 9), k))[:2])
    (best,) = [r for r in got.values() if r.best]
    assert best.rung == 1 and best.mae == min(r.mae for r in got.values() if r.rung == 1)


def test_parzen(spark):
    df = series(spark)
    bounds = bt.fold_bounds(df, BY, 2)

    def make(rounds, rate, kind):  # a valley at 0.2 of one of two kinds
        return lambda x, y, new: np.full(len(new), 100 * abs(rate - 0.2) + (kind == "worse") * 50)

    space = {"rate": tuning.Span(0.01, 1.0, log=True), "kind": tuning.Choice(("worse", "better"))}
    rows = tuning.parzen_search(df, bounds, BY, "y", ["p"], space, trials=30, batch=6, make=make, rounds=1).collect()
    far = lambda lo, hi: np.median([abs(json.loads(r.params)["rate"] - 0.2) for r in rows[lo:hi]])
    assert [r.rung for r in rows] == [k // 6 for k in range(30)] and far(18, 30) < far(0, 6)
    assert sum(json.loads(r.params)["kind"] == "better" for r in rows[12:]) >= 11
    (best,) = [r for r in rows if r.best]
    assert best.mae == min(r.mae for r in rows)
    again = tuning.parzen_search(df.repartition(5), bounds, BY, "y", ["p"], space, trials=30, batch=6, make=make, rounds=1).collect()
    assert [r.params for r in again] == [r.params for r in rows]


def test_odd_searches(spark):
    df = series(spark)
    none = tuning.halving_search(df.limit(0), bt.fold_bounds(df.limit(0), BY, 3), BY, "y", ["p"], trials=3, rungs=(1, 2)).collect()
    assert len(none) == 3 and all(np.isinf(r.mae) for r in none) and [r.best for r in none].count(True) == 1
    with pytest.raises(ValueError):
        tuning.halving_search(df, df, BY, "y", ["p"], trials=0)
    assert tuning.Span(2, 8, whole=True).at(0.5) == 5 and tuning.Span(3, 3).place(3) == 0

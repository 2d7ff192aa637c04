"""Smoothing grids against one plain pass for each point."""

from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pytest

from chronoloom.plans import exponential as ex

T0 = datetime(2024, 1, 1)
SCHEMA = "sid string, part int, time timestamp_ntz, y double"
GRID = [0.1, 0.5, 0.9]


def plain(y, a, b, g, m, holdout):
    train, test = y[:-holdout], y[-holdout:]
    if m:
        level, trend, s = train[:m].mean(), (train[m : 2 * m].mean() - train[:m].mean()) / m, list(train[:m] - train[:m].mean())
    else:
        level, trend, s = train[0], train[1] - train[0], []
    for t in range(m or 1, len(train)):
        old = s[t - m] if m else 0.0
        new = a * (train[t] - old) + (1 - a) * (level + trend)
        trend, level = b * (new - level) + (1 - b) * trend, new
        if m:
            s.append(g * (train[t] - new) + (1 - g) * old)
    ahead = [level + (h + 1) * trend + (s[len(s) - m + h % m] if m else 0.0) for h in range(holdout)]
    return float(np.abs(np.array(ahead) - test).mean())


@pytest.mark.parametrize(("season", "batch"), [(0, 10_000), (0, 3), (4, 7)])
def test_every_point(spark, season, batch):
    r = np.random.default_rng(2)
    made = {("a", 1): 80, ("a", None): 41, ("b", 2): 30, (None, 3): 2 * season + 12 if season else 12, ("short", 1): 2 * season + 9 if season else 11}
    series = {k: np.cumsum(r.normal(size=n)) + 3 * (np.arange(n) % 4) for k, n in made.items()}
    rows = [(*k, T0 + timedelta(hours=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    rows += [("a", 1, T0 + timedelta(minutes=30), None), ("b", 2, T0 + timedelta(minutes=90), float("nan")), ("none", 1, T0, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = {(x.sid, x.part): x for x in ex.grid_search(df, ["sid", "part"], "y", GRID, GRID, GRID if season else None, season, 10).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == {k for k in made if k[0] != "short"}
    for k, x in got.items():
        every = {p: plain(series[k], *(p if season else (*p, 0.0)), season, 10) for p in product(GRID, repeat=3 if season else 2)}
        best = min(every, key=lambda p: (round(every[p], 12), p))
        assert (x.alpha, x.beta, *((x.gamma,) if season else ())) == best and x.mae == pytest.approx(every[best])


def test_ties_and_errors(spark):
    rows = [("a", 1, T0 + timedelta(hours=i), float(2 * i)) for i in range(20)]
    got = ex.grid_search(spark.createDataFrame(rows, SCHEMA), ["sid"], "y", [0.5, 0.2], [0.3, 0.9], holdout=5).first()
    assert (got.alpha, got.beta) == (0.5, 0.3) and got.mae == pytest.approx(0, abs=1e-12)
    assert ex.grid_search(spark.createDataFrame([], SCHEMA), ["sid"], "y", [0.5], [0.3]).count() == 0
    with pytest.raises(ValueError):
        ex.grid_search(spark.createDataFrame([], SCHEMA), ["sid"], "y", [0.5], [0.3], season=4)

"""Direct forecasts of long horizons against a least-squares fit of every step."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.plans import horizon as hz

T0 = datetime(2024, 1, 1)
SCHEMA = "sid string, part int, time timestamp_ntz, y double, z double, x double"


def rows_of(sid, part, n, seed, holes=()):
    r = np.random.default_rng(seed)
    y, z, x = np.cumsum(r.normal(size=n)), r.normal(size=n), r.normal(size=n)
    return [(sid, part, T0 + timedelta(minutes=5 * i), None if i in holes else float(y[i]), float(z[i]), float(x[i])) for i in range(n)]


def plain(rows, lags, h, x0, penalty):
    v = np.array([[np.nan if c is None else c for c in r[3:]] for r in rows], float)
    row = lambda t, x: [1.0, *[v[t - s, c] for c in (0, 1) for s in lags], x]
    at = [t for t in range(max(lags), len(v) - h + 1) if not np.isnan(row(t, v[t, 2])).any() and not np.isnan(v[t : t + h, 0]).any()]
    a = np.array([row(t, v[t, 2]) for t in at])
    eye = penalty * np.diag([0.0] + [1.0] * (a.shape[1] - 1))
    out = []
    for k in range(h):
        out.append(np.linalg.solve(a.T @ a + eye, a.T @ v[[t + k for t in at], 0]) @ row(len(v), x0))
    return out


@pytest.mark.parametrize(("h", "batch", "block"), [(1, 10_000, 4096), (24, 7, 5), (40, 50, 64)])
def test_every_step(spark, monkeypatch, h, batch, block):
    monkeypatch.setattr(hz, "ROWS", block)
    data = {("a", 1): rows_of("a", 1, 300, 1, holes=(5, 120)), ("a", None): rows_of("a", None, 180, 2), ("b", 1): rows_of("b", 1, 250, 3)}
    rows = [r for v in data.values() for r in v] + rows_of("short", 1, 7, 4) + rows_of("gap", 1, 120, 5, holes=(117,))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        future = hz.reuse_last(df, ["sid", "part"], ["x"], 50, "5 minutes")
        got = hz.direct_long(df.dropna(subset=["sid", "part"]), future, ["sid", "part"], "y", ["z"], ["x", "absent"], [1, 3], h, 0.5).collect()
        nulls = hz.long_sums(df, ["sid", "part"], ["y", "z"], ["x"], [1, 3], h).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert nulls == 5 and {(r.sid, r.part) for r in got} == {("a", 1), ("b", 1)}
    for key in (("a", 1), ("b", 1)):
        own = sorted((r for r in got if (r.sid, r.part) == key), key=lambda r: r.step)
        v = data[key]
        assert [r.step for r in own] == list(range(1, h + 1)) and own[0].time == v[-1][2] + timedelta(minutes=5)
        assert np.allclose([r.predict_value for r in own], plain(v, [1, 3], h, v[-50][5], 0.5), atol=1e-7)


def test_the_plan_does_not_grow(spark):
    df = spark.createDataFrame(rows_of("a", 1, 30, 1), SCHEMA)
    size = [len(hz.direct_long(df, hz.reuse_last(df, ["sid"], ["x"], 5, "5 minutes"), ["sid"], "y", ["y"], ["x"], [1], h)._jdf.queryExecution().optimizedPlan().toString()) for h in (2, 288)]
    assert abs(size[0] - size[1]) < 40
    assert hz.direct_long(df.limit(0), df.limit(0), ["sid"], "y", ["y"], ["x"], [1], 3).count() == 0

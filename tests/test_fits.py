"""Sums of products, hashed splits and density clusters against plain versions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import align, anomaly
from chronoloom.plans import ensemble, learners


def test_gram_over_partitions_skips_incomplete_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    rows = [tuple(float(v) for v in r) for r in x] + [(None, 1.0, 2.0), (1.0, float("nan"), 2.0), (1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, `b.c` double, y double").repartition(7)
    a, b = learners.gram(df, ["a", "b.c"], ["y", "a"])
    z = np.c_[np.ones(200), x[:, :2]]
    assert a == pytest.approx(z.T @ z) and b == pytest.approx(z.T @ x[:, [2, 0]])
    a, b = learners.gram(df.limit(0), ["a"], ["y"])
    assert not a.any() and not b.any() and a.shape == (2, 2) and b.shape == (2, 1)


def test_ridge_of_large_values_against_exact_sums(spark):
    """Daily totals of a large table: hundreds of thousands, beside an intercept of one."""
    rng = np.random.default_rng(5)
    qty = rng.normal(120_000, 9_000, 800)
    x = np.c_[qty, 2 * qty + rng.normal(0, 4_000, 800), rng.normal(240_000, 18_000, 800)]
    y = rng.normal(240_000, 18_000, 800)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, y]], "a double, b double, c double, y double").repartition(5)
    z = [[Fraction(float(v)) for v in (1.0, *r)] for r in x]
    m = [[sum(r[i] * r[j] for r in z) for j in range(4)] + [sum(r[i] * Fraction(float(v)) for r, v in zip(z, y, strict=True))] for i in range(4)]
    for s in range(4):
        m[s] = [v / m[s][s] for v in m[s]]
        m = [r if i == s else [v - r[s] * w for v, w in zip(r, m[s], strict=True)] for i, r in enumerate(m)]
    want = sorted(float(sum(v * r[4] for v, r in zip(row, m, strict=True))) for row in z[:50])
    got = learners.Ridge().fit(df, ["a", "b", "c"], ["y"]).predict(df.filter(F.col("a").isin(*map(float, qty[:50])))).collect()
    assert sorted(r["y_hat"] for r in got) == pytest.approx(want, rel=0, abs=5e-7)


def test_split_is_the_same_in_any_order_of_rows(spark):
    df = spark.createDataFrame([(i % 900, None if i % 7 else f"v{i}") for i in range(1000)], "id int, v string")
    a, b = align.split_random(df, 0.8, keys=["id"])
    again, _ = align.split_random(df.repartition(5, "v"), 0.8, keys=["id"])
    ids = lambda d: {r["id"] for r in d.collect()}
    assert a.count() + b.count() == 1000 and ids(a) == ids(again) and not ids(a) & ids(b)
    assert 0.75 < len(ids(a)) / 900 < 0.85
    assert sum(p.count() for p in align.split_random(df, 0.5)) == 1000


def test_out_of_fold_predicts_both_halves(spark):
    rows = [(i, float(i % 13), 3.0 * (i % 13) + 1) for i in range(120)]
    df = spark.createDataFrame(rows, "time int, p double, y double")
    train, test = ensemble.out_of_fold(df.filter("time < 90"), df.filter("time >= 90"), ["p"], "y", {"a": learners.Ridge()}, "time", 3)
    got = [(r["y"], r["a_oof"]) for r in train.union(test.select(*train.columns)).collect()]
    assert len(got) == 120 and all(p == pytest.approx(y) for y, p in got)


def test_dbscan_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(9, 1, (50, 2)), rng.uniform(-20, 20, (15, 2))]
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "sid string, time int, a double, b double")
    got = {r["time"]: r["cluster"] for r in anomaly.dbscan(df, ["sid"], "time", ["a", "b"], 1.2, 5).collect()}
    near = ((x[:, None] - x) ** 2).sum(2) <= 1.2**2
    core = near.sum(1) >= 5
    reach = near & core[:, None] & core
    for _ in range(8):
        reach = reach | (reach.astype(int) @ reach.astype(int) > 0)
    first = {i: int(np.flatnonzero(reach[i])[0]) for i in np.flatnonzero(core)}
    number = {f: n for n, f in enumerate(sorted(set(first.values())))}
    for i in range(len(x)):
        owners = {number[first[j]] for j in np.flatnonzero(near[i] & core)}
        assert got[i] == (number[first[i]] if core[i] else min(owners, default=-1))

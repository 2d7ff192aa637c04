"""Whitening against one decomposition of all rows, and the defined results of odd rows."""

import math
import random

import numpy as np
import pytest

from chronoloom.llm import whiten

SCHEMA = "vec_id long, embedding array<double>"


def expected(rows, count=4):
    """By vec_id: (n, deviation, |whitened| by component, explained)."""
    x = {i: np.array([math.floor(256 * c) for c in v], object) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(0)
    apart = ((n * fit - s) / n).astype(np.float64)
    e, u = np.linalg.eigh(apart.T @ apart / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    total = np.trace(apart.T @ apart / n)
    return {i: (n, int(((n * v - s) ** 2).sum()), np.abs(((n * v - s) / n).astype(float) @ u / np.sqrt(e)), e / total) for i, v in x.items()}


def compare(got, want):
    seen = {(r.vec_id, r.component): r for r in got}
    assert len(seen) == len(got) == sum(len(w[3]) for w in want.values())
    for i, (n, deviation, w, explained) in want.items():
        for k in range(len(w)):
            r = seen[i, k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert math.isclose(abs(r.whitened), w[k], rel_tol=1e-6, abs_tol=1e-7) and math.isclose(r.explained, explained[k], rel_tol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


@pytest.mark.parametrize("parts", [1, 40])
def test_against_one_decomposition(spark, monkeypatch, parts):
    monkeypatch.setattr(whiten, "BLOCK", 7)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 2.0 ** (3 - k)) + 1000 for k in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows the same
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 x", "2 part", "3 n")
    compare(whiten.whiten(df).collect(), expected(rows))


def test_one_sign_for_all_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 3), r.gauss(0, 1)]) for i in range(60)]
    got = {(x.vec_id, x.component): x.whitened for x in whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    w = np.array([[got[i, k] for k in (1, 2)] for i in range(60)])
    assert np.abs(w.mean(0)).max() < 1e-9 and np.abs(np.cov(w.T, ddof=0) - np.eye(2)).max() < 1e-9


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    compare(whiten.op12_whitening(spark, sf).collect(), expected(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, [0.25, 0.75]), (3, [1.0, -0.0]), (3, [1.0, 0.0]), (None, [0.5, -0.5]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [None, 1.0]), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), k) for i in (1, 2, 3, 3, None) for k in (1, 2))
    assert {r.n for r in got} == {3} and {r.deviation for r in got if r.vec_id is None} == {r.deviation for r in got if r.vec_id == 1}


def test_without_variance(spark):
    flat = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(1, 0, None, None, None)] * 4
    line = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in line)
    assert all(r.identity_error < 1e-9 for r in line) and abs(sum(r.explained for r in line if r.vec_id == 0) - 1) < 1e-12
    assert whiten.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_entries(spark):
    rows = [(i, [1e12 * i, -1e12, 5.0]) for i in range(4)] + [(9, [1.0, 2.0, 3.0])]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = expected(rows)
    for r in got:
        assert r.deviation == (want[r.vec_id][1] if want[r.vec_id][1] < 1 << 63 else None)

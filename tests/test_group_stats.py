"""Scores against a group's own mean and deviation, of groups too large for a window in one task."""

import math
from statistics import mean, pstdev

import pytest

from chronoloom.operators import align, anomaly

ROWS = [(g, i, float((i * 7919) % 101) if i % 10 else None) for g in ("a", None, "b") for i in range(300)] + [("one", 0, 5.0), ("b", 900, 4000.0), (None, 901, -3000.0)]


@pytest.mark.parametrize("make", [lambda df: align.remove_outliers(df, ["g"], "y", 1.5), lambda df: anomaly.n_sigma(df, ["g"], "y"), lambda df: anomaly.z_score(df, ["g"], "y"), lambda df: anomaly.residual_z(df, ["g"], "i", "y")])
def test_no_group_meets_in_one_window(spark, make):
    df = spark.createDataFrame(ROWS, "g string, i int, y double")
    assert "Window" not in make(df)._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_any_key(spark):
    df = spark.createDataFrame(ROWS, "g string, i int, y double")
    want = set()
    for g in {g for g, _, _ in ROWS}:
        own = [(i, y) for k, i, y in ROWS if k == g and y is not None]
        m, s = mean(y for _, y in own), pstdev(y for _, y in own)
        want |= {(g, i) for i, y in own if s and abs(y - m) / s < 1.5}
    assert {(r.g, r.i) for r in align.remove_outliers(df, ["g"], "y", 1.5).collect()} == want
    z = {(r.g, r.i): r.y_zscore for r in anomaly.z_score(df, ["g"], "y").collect()}
    assert len(z) == len(ROWS) and z["one", 0] is None and all((z[k] is not None and abs(z[k]) < 1.5) == (k in want) for k in z)
    y = [y for _, _, y in ROWS if y is not None]
    whole = {(r.g, r.i): r.y_zscore for r in anomaly.z_score(df, [], "y").collect()}
    assert math.isclose(whole["one", 0], (5.0 - mean(y)) / pstdev(y))

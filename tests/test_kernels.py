"""Kernels that take many positions of a series at once, against their definitions position by position."""

import time

import numpy as np
import pytest

from chronoloom.operators import anomaly, chunks, smooth


def plain_lowess(y, share):
    n = len(y)
    t, k, known, fit = np.arange(n, dtype=float), max(3, int(np.ceil(share * n))), ~np.isnan(y), np.full(n, np.nan)
    for i in range(n):
        if not known.any():
            continue
        d = np.abs(t - t[i])
        h = np.sort(d[known])[min(k, known.sum()) - 1]
        w = np.where(known, np.clip(1 - (d / max(h, 1e-9) / 1.0001) ** 3, 0, None) ** 3, 0)
        s, m = w.sum(), (w * t).sum() / w.sum()
        ym, var = (w[known] * y[known]).sum() / s, (w * (t - m) ** 2).sum()
        fit[i] = ym + ((w * (t - m))[known] * (y[known] - ym)).sum() / var * (t[i] - m) if var > 1e-12 else ym
    return fit


@pytest.mark.parametrize("n", [1, 2, 3, 7, 60, 301])
@pytest.mark.parametrize("gaps", [0.0, 0.4, 0.97, 1.0])
@pytest.mark.parametrize("share", [0.05, 0.3, 1.0])
def test_lowess(monkeypatch, n, gaps, share):
    monkeypatch.setattr(smooth, "CELLS", 500)
    r = np.random.default_rng(n)
    y = np.where(r.random(n) < gaps, np.nan, r.normal(50, 20, n))
    got, want = smooth.lowess_kernel(y, share), plain_lowess(y, share)
    np.testing.assert_allclose(got["smooth"], want, rtol=1e-9, atol=1e-9)
    if not np.isnan(y).all():
        np.testing.assert_allclose(got["high"] - got["low"], np.full(n, 2 * 1.96 * np.nanstd(y - want)), atol=1e-7)


def test_lowess_of_a_long_series_is_no_sort_a_position():
    y = np.random.default_rng(1).normal(0, 1, 20_000)
    start = time.process_time()
    smooth.lowess_kernel(y, 0.005)
    assert time.process_time() - start < 2  # position by position, a quarter of it took 1.8 s


def test_series_longer_and_shorter_than_a_batch(spark):
    """Each series goes through the kernel once and whole, wherever the batches end."""
    rows = [(k, t, float(t * 31 % 97) if (t + k) % 9 else None) for k in range(40) for t in range(k * k % 83 + 1)] + [(None, t, 1.0) for t in range(5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        df = spark.createDataFrame(rows[::-1], "sid int, t int, y double").repartition(3)
        got = chunks.each_series(df, ["sid"], "t", "y", lambda y: {"n": np.full(len(y), len(y)), "sum": np.full(len(y), np.nansum(y)), "at": np.arange(len(y))}, "n bigint, sum double, at bigint").collect()
        none = chunks.each_series(df.filter("sid < 0"), ["sid"], "t", "y", lambda y: {"n": y}, "n double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and not none
    for r in got:
        own = [y for k, _, y in rows if k == r.sid]
        assert (r.n, r["sum"], r.at) == (len(own), sum(y or 0 for y in own), r.t)


@pytest.mark.parametrize("k", [0.5, 2.0, 4.0])
@pytest.mark.parametrize("gaps", [0.0, 0.1, 1.0])
def test_shifting_band_step_by_step(monkeypatch, k, gaps):
    r, p = np.random.default_rng(5), 6
    made = np.lib.stride_tricks.sliding_window_view
    calls = []
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda *a: calls.append(1) or made(*a))
    for n in (0, 3, 12, 13, 700):
        y = np.where(r.random(n) < gaps, np.nan, r.normal(50, 10, n) + 60 * (r.random(n) < 0.03))
        calls.clear()
        got = anomaly.shifting_kernel(y, p, k)
        z, flag, smooth_ = y.copy(), np.zeros(n, bool), np.full(n, np.nan)
        for i in range(2 * p, n):
            past = z[i - 2 * p : i]
            smooth_[i] = past[p:].mean() + (past[p] + past[0] - past[:p].mean() - past[p:].mean()) / 2
            if np.isnan(z[i]) or abs(z[i] - smooth_[i]) > k * past.std():
                flag[i], z[i] = not np.isnan(z[i]), smooth_[i]
        np.testing.assert_allclose(got["smooth"], smooth_, rtol=1e-12)
        assert (got["is_anomaly"] == flag).all()
        if n == 700 and k == 4.0 and not gaps:
            assert len(calls) < n / 4  # not a step a row

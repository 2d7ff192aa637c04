"""Smoothers: frames where a frame can say it, kernels for each series where not."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.align import over
from chronoloom.operators.chunks import each_series

Cols = Sequence[str]


def moving_average(df: DataFrame, by: Cols, order: Cols, column: str, size: int = 11) -> DataFrame:
    """``smooth``: centred mean of an odd size; near the edges the window shrinks on both sides alike; short series stay."""
    if size % 2 == 0:
        raise ValueError("size must be odd")
    w, half = over(by, order), size // 2
    pos = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    r = F.least(F.col("_i"), F.col("_n") - 1 - F.col("_i"), F.lit(half))
    value = F.coalesce(*[F.when(r == k, F.avg(column).over(w.rowsBetween(-k, k))) for k in range(half + 1)])
    return pos.withColumn("smooth", F.when(F.col("_n") < size, F.col(column)).otherwise(value)).drop("_i", "_n")


def moving_median(df: DataFrame, by: Cols, order: Cols, column: str, size: int, direction: str = "left") -> DataFrame:
    """``smooth``: median of the rows from this one on (``left``, the tail repeats the last), or of those before it (``right``, the head repeats the first), or forward with the reversed head appended (``circle``)."""
    w = over(by, order)
    pos = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    whole = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if direction == "left":
        own = pos.withColumn("_m", F.percentile(column, F.lit(0.5)).over(w.rowsBetween(0, size - 1)))
        edge = F.max(F.when(F.col("_i") == F.col("_n") - size - 1, F.col("_m"))).over(whole)
        out = own.withColumn("smooth", F.when(F.col("_i") < F.col("_n") - size, F.col("_m")).otherwise(edge))
    elif direction == "right":
        own = pos.withColumn("_m", F.percentile(column, F.lit(0.5)).over(w.rowsBetween(-size, -1)))
        edge = F.max(F.when(F.col("_i") == size, F.col("_m"))).over(whole)
        out = own.withColumn("smooth", F.when(F.col("_i") >= size, F.col("_m")).otherwise(edge))
    elif direction == "circle":
        head = pos.filter(F.col("_i") < size).withColumn("_j", F.col("_n") + size - 1 - F.col("_i")).withColumn("_own", F.lit(False))
        both = pos.withColumns({"_j": F.col("_i"), "_own": F.lit(True)}).unionByName(head)
        v = Window.partitionBy(*by).orderBy("_j")
        out = both.withColumn("smooth", F.percentile(column, F.lit(0.5)).over(v.rowsBetween(0, size - 1))).filter("_own").drop("_j", "_own")
    else:
        raise ValueError(f"unknown direction: {direction}")
    return out.drop("_i", "_n", "_m")


def on_off(df: DataFrame, by: Cols, order: Cols, column: str, threshold: float, size: int = 5, condition: str = "and") -> DataFrame:
    """``smooth`` is 1 where all (``and``) or any (``or``) values of the centred window pass the threshold."""
    frame = over(by, order).rowsBetween(-(size // 2), size // 2)
    x = F.min(column).over(frame) if condition == "and" else F.max(column).over(frame)
    return df.withColumn("smooth", F.when(x > threshold, 1).otherwise(0))


#: Weights held at once by ``lowess_kernel``.
CELLS = 1 << 18


def lowess_kernel(y: np.ndarray, share: float = 0.3) -> dict[str, np.ndarray]:
    """Tricube-weighted local lines, with a band of 1.96 residual deviations; many positions at once, each with the weights within its reach only."""
    n, known = len(y), ~np.isnan(y)
    at, fit = np.flatnonzero(known), np.full(n, np.nan)
    if not len(at):
        return {"smooth": fit, "low": fit, "high": fit}
    t, k = np.arange(n), min(max(3, int(np.ceil(share * n))), len(at))
    first, last = at[: len(at) - k + 1], at[k - 1 :]  # of each run of k known positions
    turn = np.searchsorted(first + last, 2 * t)  # of the first run whose middle isn't before the position: it or the one before is nearest
    h = np.minimum(*(np.maximum(t - first[j], last[j] - t) for j in (turn.clip(0, len(first) - 1), (turn - 1).clip(0, len(first) - 1))))
    order, reach = np.argsort(h, kind="stable"), (h * 1.0001).astype(int)
    i = 0
    while i < n:
        rows = order[i : i + max(1, CELLS // (2 * int(reach[order[i]]) + 1))]
        r = int(reach[rows[-1]])
        rows = rows[: max(1, CELLS // (2 * r + 1))]
        i += len(rows)
        x = np.arange(-r, r + 1, dtype=float)
        seen, ys = (np.lib.stride_tricks.sliding_window_view(np.pad(v, r), 2 * r + 1)[rows] for v in (known, np.where(known, y, 0.0)))
        d = np.abs(x) / (np.maximum(h[rows], 1e-9) * 1.0001)[:, None]
        w = np.clip(1 - d * d * d, 0, None)
        w = w * w * w * seen
        s = w.sum(1)
        m, ym = w @ x / s, (w * ys).sum(1) / s
        wx = w * (x - m[:, None])
        var = (wx * (x - m[:, None])).sum(1)
        slope = (wx * (ys - ym[:, None])).sum(1) / np.where(var > 1e-12, var, np.inf)
        fit[rows] = ym - slope * m
    s = np.nanstd(y - fit)
    return {"smooth": fit, "low": fit - 1.96 * s, "high": fit + 1.96 * s}


def lowess(df: DataFrame, by: Cols, order: str, column: str, share: float = 0.3) -> DataFrame:
    return each_series(df, by, order, column, lambda y: lowess_kernel(y, share), "smooth double, low double, high double")


def kalman_kernel(y: np.ndarray, level: float = 0.1, trend: float = 0.01, noise: float = 1.0) -> dict[str, np.ndarray]:
    """Local level and trend: filter, then smoother; missing values are bridged."""
    n = len(y)
    a = np.array([[1.0, 1.0], [0.0, 1.0]])
    q, h = np.diag([level, trend]), np.array([1.0, 0.0])
    first = y[~np.isnan(y)]
    x, p = np.array([first[0] if len(first) else 0.0, 0.0]), np.eye(2) * 1e3
    xs, ps, xp, pp = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    for i in range(n):
        xp[i], pp[i] = (x, p) if i == 0 else (a @ x, a @ p @ a.T + q)
        x, p = xp[i], pp[i]
        if not np.isnan(y[i]):
            gain = p @ h / (h @ p @ h + noise)
            x, p = x + gain * (y[i] - h @ x), p - np.outer(gain, h @ p)
        xs[i], ps[i] = x, p
    for i in range(n - 2, -1, -1):
        c = ps[i] @ a.T @ np.linalg.inv(pp[i + 1])
        xs[i] = xs[i] + c @ (xs[i + 1] - xp[i + 1])
    return {"smooth": xs[:, 0], "slope": xs[:, 1]}


def kalman(df: DataFrame, by: Cols, order: str, column: str, level: float = 0.1, trend: float = 0.01, noise: float = 1.0) -> DataFrame:
    return each_series(df, by, order, column, lambda y: kalman_kernel(y, level, trend, noise), "smooth double, slope double")

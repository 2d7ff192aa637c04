"""Robust location and covariance by concentration steps, and outliers by their distance from it.

The start is found on a bounded sample: the ``SAMPLE`` rows with the smallest hash of their values are
collected and many random subsets concentrated there; the ``KEPT`` best go on over all rows. Each further step is one
aggregate over all rows for every start at once: their sums by distance, in bins that are narrow where the wanted share of
rows is expected to end. It gives both that limit and the sums of the rows within it; a start whose limit fell outside, or in a
bin of too many rows, is read again in narrower bins. Distances, the consistency factors and the reweighting cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import small_batches

Cols = Sequence[str]
Place = tuple[np.ndarray, np.ndarray]  # location and covariance

SAMPLE, STARTS, KEPT, STEPS = 1000, 60, 5, 30
BINS, SKETCH = 256, 10_000  # bins of distances, and the share of rows (1 / SKETCH) that a limit may be off
#: Edges of the first bins, as parts of the expected limit: narrowest around it. Few rows lie within them all, as sums by bin cost more than those below.
REACH = np.concatenate((np.geomspace(0.95, 0.992, 28), np.linspace(0.992, 1.008, 200), np.geomspace(1.008, 1.05, 28)))


def chi2_quantile(p: float, k: int) -> float:
    """The value below which a chi-square variable of ``k`` degrees lies with probability ``p``, by bisection of the series of the incomplete gamma function."""

    def below(x: float) -> float:
        a, h = k / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-17:
            n += 1
            term *= h / (a + n)
            total += term
        return total * math.exp(a * math.log(h) - h - math.lgamma(a)) if h > 0 else 0.0

    low, high = 0.0, k + 10.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


@dataclass(frozen=True)
class Envelope:
    columns: list[str]
    location: np.ndarray
    covariance: np.ndarray
    support: int  # rows that the estimate rests on

    def distance(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of rows."""
        return _distances(x, self.location, self.covariance)


def _distances(x: np.ndarray, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - m
    return np.einsum("ij,ij->i", d @ np.linalg.pinv(c, hermitian=True), d)


def _concentrated(x: np.ndarray, h: int, m: np.ndarray, c: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    for _ in range(steps):
        at = np.argsort(_distances(x, m, c), kind="stable")[:h]
        m, c = x[at].mean(0), np.cov(x[at].T, ddof=0).reshape(len(m), -1)
    return float(np.linalg.slogdet(c)[1]), m, c


def _starts(x: np.ndarray, share: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best ``KEPT`` of many starts, concentrated twice and then further on the sample."""
    n, p = x.shape
    h, r = max(p + 1, min(n, math.ceil(share * n))), np.random.default_rng(seed)
    found = []
    for _ in range(STARTS):
        own = x[r.choice(n, min(n, p + 1), replace=False)]
        found.append(_concentrated(x, h, own.mean(0), np.cov(own.T, ddof=0).reshape(p, -1), 2))
    found.sort(key=lambda f: f[0])
    return [(m, c) for _, m, c in (_concentrated(x, h, m, c, 10) for _, m, c in found[:KEPT])]


def _distance(x: Sequence[Column], m: np.ndarray, c: np.ndarray) -> Column:
    """The squared distance as a column."""
    off = [v - float(a) for v, a in zip(x, m, strict=True)]
    inner = [reduce(add, [o * float(w) for o, w in zip(off, row, strict=True)]) for row in np.linalg.pinv(c, hermitian=True)]
    return reduce(add, [o * i for o, i in zip(off, inner, strict=True)])


def _keys(d: np.ndarray) -> np.ndarray:
    """Longs in the order of the distances: bins of these are fine at any scale."""
    return (np.maximum(d, 0.0) + 0.0).view(np.int64)


def _edges(low: int, high: int) -> list[int]:
    """Upper edges of ``BINS`` bins from the key ``low`` to ``high``; a bin before and one after these take what lies outside."""
    return sorted({low + (high - low) * i // BINS for i in range(BINS + 1)})


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows as blocks of doubles, a column after another, so that a pass over them only reads memory or a local disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.vstack([c.to_numpy(zero_copy_only=False) for c in b.columns]).tobytes()], pa.binary())], ["x"])

    return rows.mapInArrow(run, "x binary")


def _binned(blocks: DataFrame, p: int, around: Sequence[Place], edges: Sequence[Sequence[int]]) -> list[dict[int, tuple[np.ndarray, int, int]]]:
    """For each of ``around``: bin -> (sums of the products of 1 and the offsets, keys from, keys to) of the rows there. The bin past the last edge has no sums."""
    one, other = np.triu_indices(p + 1)
    size = len(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [np.array(e, np.int64) for e in edges]
        inverse = [np.linalg.pinv(c, hermitian=True) for _, c in around]
        total = [np.zeros((len(e) + 1, size)) for e in edges]
        least = [np.full(len(e) + 1, np.iinfo(np.int64).max) for e in edges]
        most = [np.full(len(e) + 1, -1) for e in edges]
        for x in (np.frombuffer(v.as_buffer()).reshape(p, -1) for b in batches for v in b.columns[0]):
            on = np.ones((p + 1, x.shape[1]))
            for k, (m, _) in enumerate(around):
                off = np.subtract(x, m[:, None], out=on[1:])
                key = _keys(np.einsum("ij,ij->j", inverse[k] @ off, off))
                low, high, below = key.min(), key.max(), key <= upper[k][0]
                total[k][0] += ((on * below) @ on.T)[one, other]
                if low <= upper[k][0]:
                    least[k][0], most[k][0] = min(least[k][0], low), max(most[k][0], np.where(below, key, -1).max())
                if high > upper[k][-1]:
                    least[k][-1], most[k][-1] = upper[k][-1] + 1, max(most[k][-1], high)
                at = np.flatnonzero(below ^ (key <= upper[k][-1]))
                if len(at):
                    i, y = np.searchsorted(upper[k], key[at]), on[:, at]
                    cells = i * size + np.arange(size)[:, None]
                    total[k] += np.bincount(cells.ravel(), (y[one] * y[other]).ravel(), total[k].size).reshape(total[k].shape)
                    np.minimum.at(least[k], i, key[at])
                    np.maximum.at(most[k], i, key[at])
        for k in range(len(around)):
            i = np.flatnonzero(most[k] >= 0)
            if len(i):
                arrays = [np.full(len(i), k, np.int32), i.astype(np.int32), least[k][i], most[k][i]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.FixedSizeListArray.from_arrays(total[k][i].ravel(), size).cast(pa.list_(pa.float64()))], ["k", "bin", "least", "most", "v"])

    cells = blocks.mapInArrow(run, "k int, bin int, least bigint, most bigint, v array<double>").select("k", "bin", "least", "most", F.posexplode("v").alias("cell", "v"))
    got = cells.groupBy("k", "bin", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("v").alias("v")).toArrow()  # a row for each entry of the matrices
    k, i, cell, least, most, v = (c.to_numpy() for c in got.columns)
    at = np.lexsort((cell, i, k))
    out: list[dict[int, tuple[np.ndarray, int, int]]] = [{} for _ in around]
    for sums, first in zip(v[at].reshape(-1, size), at[::size], strict=True):
        t = np.zeros((p + 1, p + 1))
        t[one, other] = t[other, one] = sums
        out[k[first]][int(i[first])] = t, int(least[first]), int(most[first])
    return out


def _estimate(m: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) from sums around ``m``."""
    off = t[0, 1:] / t[0, 0]
    return int(t[0, 0]), m + off, t[1:, 1:] / t[0, 0] - np.outer(off, off)


def _within(blocks: DataFrame, p: int, around: Sequence[Place], limits: Sequence[float]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, mean, covariance) of the rows within each limit."""
    found = _binned(blocks, p, around, [[int(_keys(np.array([v]))[0])] for v in limits])
    return [_estimate(m, f[0][0]) for (m, _), f in zip(around, found, strict=True)]


def _nearest(blocks: DataFrame, n: int, p: int, around: Sequence[Place], share: float, expected: Sequence[float]) -> list[tuple[float, tuple[int, np.ndarray, np.ndarray]]]:
    """For each of ``around``: the distance within which ``share`` of the ``n`` rows lie, and (rows, mean, covariance) of these; ``expected`` distances only save passes.

    A limit is the largest distance of a bin, of at most n / SKETCH rows, which count by the part of them that is wanted, or of equal distances but for rounding.
    """
    rank = min(n, max(1, math.ceil(share * n)))
    edges = [np.unique(_keys(e * REACH)).tolist() for e in expected]
    out: dict[int, tuple[float, tuple[int, np.ndarray, np.ndarray]]] = {}
    while len(out) < len(around):
        left = [k for k in range(len(around)) if k not in out]
        for k, bins in zip(left, _binned(blocks, p, [around[k] for k in left], [edges[k] for k in left]), strict=True):
            total, past = np.zeros((p + 1, p + 1)), len(edges[k])
            for i, (t, least, most) in sorted(bins.items()):
                here = n - total[0, 0] if i == past else t[0, 0]
                if i < past and total[0, 0] + here < rank:
                    total += t
                    continue
                equal = most - least < 1 << 12
                if i < past and (total[0, 0] + here == rank or here <= n // SKETCH or equal):
                    part = 1.0 if equal else (rank - total[0, 0]) / here
                    out[k] = float(np.array([most]).view(float)[0]), _estimate(around[k][0], total + part * t)
                else:
                    edges[k] = _edges(least - 1, most)
                break
    return [out[k] for k in range(len(around))]


def _concentrate(blocks: DataFrame, n: int, p: int, few: np.ndarray, around: list[Place], share: float) -> Place:
    """The place of least determinant that steps over all rows lead to."""
    expected = [float(np.quantile(_distances(few, m, c), share)) for m, c in around]
    best, before = around[0], math.inf
    for _ in range(STEPS):
        found = _nearest(blocks, n, p, around, share, expected)
        around, expected = [(m, c) for _, (_, m, c) in found], [limit for limit, _ in found]
        dets = [float(np.linalg.slogdet(c)[1]) for _, c in around]
        k = min(range(len(dets)), key=lambda i: dets[i])
        best, now = around[k], dets[k]
        if not now < before - 1e-9:
            break
        before = now
    return best


def fit_envelope(df: DataFrame, columns: Cols, share: float | None = None, seed: int = 42) -> Envelope | None:
    """The minimum covariance determinant of the complete rows, consistent at the normal distribution and reweighted once.

    ``share`` of the rows is concentrated on, by default the least that still breaks down last, (n + p + 1) / 2n. Rows with a missing or infinite
    value are left out; without rows there is none. A constant column has no part in a distance. Limits of distances
    may be off by one in ten thousand rows and are exact for as many rows.
    """
    p = len(columns)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.filter(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i}) AND abs(x{i}) < double('inf')" for i in range(p)))
    n = rows.count()
    if not n:
        return None
    share = min(1.0, (n + p + 1) / 2 / n) if share is None else share
    few = rows.withColumn("h", F.xxhash64(*rows.columns)).orderBy("h", *rows.columns).limit(SAMPLE).drop("h").toPandas().to_numpy(float)  # at most SAMPLE rows
    around = _starts(few, share, seed)
    with small_batches(df.sparkSession):
        blocks = _blocks(rows).persist(StorageLevel.DISK_ONLY)
        try:
            best = _concentrate(blocks, n, p, few, around, share)
            middle = _middle(rows, p, *best)
            covariance = best[1] * (middle / chi2_quantile(0.5, p) if middle > 0 else 1.0)
            (support, m, c), = _within(blocks, p, [(best[0], covariance)], [chi2_quantile(0.975, p)])
        finally:
            blocks.unpersist()
    middle = _middle(rows, p, m, c)
    return Envelope(list(columns), m, c * (middle / chi2_quantile(0.5, p) if middle > 0 else 1.0), support)


def _middle(rows: DataFrame, p: int, m: np.ndarray, c: np.ndarray) -> float:
    d = rows.select(_distance([F.col(f"x{i}") for i in range(p)], m, c).alias("d"))
    return d.agg(F.percentile_approx("d", 0.5, SKETCH)).first()[0]


def elliptic_envelope(df: DataFrame, columns: Cols, contamination: float = 0.1, share: float | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``distance`` (squared, null for incomplete rows) and ``is_anomaly``: beyond the distance that ``contamination`` of the complete rows exceed."""
    p = len(columns)
    found = fit_envelope(df, columns, share, seed)
    kept = [c for c in df.columns if c not in ("distance", "is_anomaly")]
    m, c = (found.location, found.covariance) if found else (np.zeros(p), np.eye(p))
    x = [F.col(f"`{k}`").cast("double") for k in columns]
    whole = reduce(and_, [F.abs(v) < math.inf for v in x])  # neither null nor NaN, which is above all
    out = df.select(*[F.col(f"`{k}`") for k in kept], F.when(whole, _distance(x, m, c)).alias("distance"))
    limit = out.agg(F.percentile_approx("distance", 1 - contamination, SKETCH).alias("_limit"))
    return out.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.coalesce(F.col("distance") > F.col("_limit"), F.lit(False))).drop("_limit")  # one row

"""A quality classifier by Bradley-Terry pairwise ranking.

Each text gets features of its bytes and words.  A linear score w.x is learned from
preference pairs (a text labelled good over one labelled bad of the training rows) by
logistic loss on the difference of their features.  The cut is a quantile of the
training scores; a logistic map with value THRESHOLD at the cut gives scores in (0, 1).

The model is fitted on all labelled training rows and all their pairs, by sums over
slices of the rows; scoring covers every row.  Labels, language, source and id are no
inputs of a score.

Defined results: null and empty texts are scored as texts without words; rows without
an id are scored and count as training rows that can't have a label; repeated or
contradicting labels of an id are averaged and count as good from one half; of several
texts of a labelled id the least in order teaches; null labels are skipped; without both classes every score is the map of zero; an empty table gives
an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronoloom.llm.common import durable, require, small

FOLDS, THRESHOLD = 5, 0.3
#: The cut lies between these quantiles of the training scores.
QUANTILES = 0.005, 0.6
#: Rows of a slice (about); bins of a class's utilities in a slice, of all of them, of the mixed curvature, and steps of the cut.
SLICE, CELLS, BINS, COARSE, EDGES = 1 << 14, 512, 1024, 64, 4096

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!?", "$%#&*@^~", "|<>{}[]\\=_", "()'\"-/+`"), 1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 12
N_CLASS = 13
N_FEATURES = 2 * N_CLASS + 12


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes (and their square roots), and shapes of words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), N_CLASS) / n
    words = raw.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    caps = sum(map(bytes.isupper, words)) / m
    alnum = sum(map(bytes.isalpha, words)) / m
    lines = raw.split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    mean = size.mean()
    shape = (np.log1p(len(words)) / 10, float(not words), min(mean, 40) / 10, min(size.std(), 40) / 10, size.max() > 40, distinct / m, same, np.sqrt(same), caps, alnum, repeated, np.log1p(len(lines) / m))
    return np.concatenate((share, np.sqrt(share), np.array(shape, np.float64)))


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sweep(rows: DataFrame, stats: Callable[[Iterable[tuple[np.ndarray, np.ndarray]]], np.ndarray]) -> list[np.ndarray]:
    """``stats`` of the (features, good) of each slice, in the order of the slices; empty slices give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column(0).values.to_numpy().reshape(-1, N_FEATURES), b.column(1).to_numpy(zero_copy_only=False) >= 0.5) for b in batches if b.num_rows)
        if (first := next(parts, None)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([stats(chain([first], parts))], pa.list_(pa.float64()))], ["s"])

    return [np.array(r["s"]) for r in rows.select("x", "y").mapInArrow(run, "s array<double>").collect()]  # one row a slice


def _sum(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def _moments(slices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and deviation of the features, numbers of good and bad rows."""
    n, good, mean, square = 0.0, 0.0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for s in slices:
        m, apart = s[0], s[2 : 2 + N_FEATURES] - mean
        square += s[2 + N_FEATURES :] + apart**2 * n * m / (n + m)
        mean = mean + apart * m / (n + m)
        n, good = n + m, good + s[1]
    return mean, np.sqrt(square / max(n, 1.0)), good, n - good


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


class Utilities:
    """The utilities of both classes as points with weights: bins of each slice with their own means, merged into ``BINS``."""

    def __init__(self, slices: list[np.ndarray]):
        cells = np.concatenate([s.reshape(2, 2, -1) for s in slices], axis=2)  # class, (count, sum), cell
        held = [c[:, c[0] > 0] for c in cells]
        at = [c[1] / c[0] for c in held]
        self.low, self.high = min(map(np.min, at)), max(map(np.max, at))
        self.width = max(self.high - self.low, 1e-9)
        self.share, self.point = [], []
        for c, m in zip(held, at, strict=True):
            k = np.minimum((m - self.low) / self.width * BINS, BINS - 1).astype(int)
            count, total = np.bincount(k, c[0], BINS), np.bincount(k, c[1], BINS)
            self.share.append(count[count > 0] / count.sum())
            self.point.append(total[count > 0] / count[count > 0])

    def loss(self) -> float:
        apart = self.point[1] - self.point[0][:, None]  # good less bad
        return float(self.share[0] @ np.logaddexp(0, -apart) @ self.share[1])

    def tables(self) -> tuple[np.ndarray, ...]:
        """On a grid: the mean over the other class of a pair's gradient and of its curvature, for a good and for a bad row."""
        grid = np.linspace(self.low, self.high, 2 * BINS + 1)
        bad, good = _sigmoid(self.point[0] - grid[:, None]), _sigmoid(grid[:, None] - self.point[1])
        return grid, bad @ self.share[0], (bad * (1 - bad)) @ self.share[0], good @ self.share[1], (good * (1 - good)) @ self.share[1]


def fit(rows: DataFrame, steps: int = 40, ridge: float = 1e-3) -> Ranker:
    """Bradley-Terry weights from all (good, bad) pairs of ``rows`` (x, y), and the cut by score quantile.

    Newton steps on the mean logistic loss.  A row's pairs with the whole other class enter through that
    class's distribution of utilities, held as bins with their means, so a step is two passes over the rows
    and only sums by slice come to the driver.
    """

    def moments(parts):
        n, good, mean, square = 0.0, 0.0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for x, y in parts:
            m, own = len(x), x.mean(0)
            square += ((x - own) ** 2).sum(0) + (own - mean) ** 2 * n * m / (n + m)
            mean = mean + (own - mean) * m / (n + m)
            n, good = n + m, good + y.sum()
        return np.concatenate(([n, good], mean, square))

    mean, scale, goods, bads = _moments(_sweep(rows, moments))
    if not goods or not bads:
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    scale = np.where(scale > 1e-9, scale, 1.0)

    def standard(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -6, 6)

    def utilities(w: np.ndarray) -> Utilities:
        def stats(parts):
            got = [(standard(x) @ w, y) for x, y in parts]
            u, y = (np.concatenate(v) for v in zip(*got, strict=True))
            out = np.zeros((2, 2, CELLS))
            for k in (0, 1):
                if len(own := u[y == k]):
                    cell = np.minimum((own - own.min()) / max(np.ptp(own), 1e-9) * CELLS, CELLS - 1).astype(int)
                    out[k] = np.bincount(cell, minlength=CELLS), np.bincount(cell, own, CELLS)
            return out.ravel()

        return Utilities(_sweep(rows, stats))

    def slopes(w: np.ndarray, at: Utilities) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the mean loss; what a pair's two rows share of the curvature is summed by coarse bins."""
        grid, *tables = at.tables()
        low, width = at.low, at.width

        def stats(parts):
            grad, curve, sums = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES)), np.zeros((2, COARSE, N_FEATURES))
            for x, y in parts:
                z = standard(x)
                u = z @ w
                for k, first, second, sign, total in ((1, *tables[:2], -1, goods), (0, *tables[2:], 1, bads)):
                    zk, uk = z[y == k], u[y == k]
                    grad += sign * (np.interp(uk, grid, first) @ zk) / total
                    curve += (zk * np.interp(uk, grid, second)[:, None]).T @ zk / total
                    np.add.at(sums[k], np.clip((uk - low) / width * COARSE, 0, COARSE - 1).astype(int), zk / total)
            return np.concatenate((grad, curve.ravel(), sums.ravel()))

        got = _sum(_sweep(rows, stats))
        grad, curve, sums = np.split(got, [N_FEATURES, N_FEATURES + N_FEATURES**2])
        curve, sums = curve.reshape(N_FEATURES, N_FEATURES), sums.reshape(2, COARSE, N_FEATURES)
        centre = low + (np.arange(COARSE) + 0.5) * width / COARSE
        pair = _sigmoid(centre[:, None] - centre)
        mixed = sums[1].T @ (pair * (1 - pair)) @ sums[0]
        return grad + ridge * w, curve - mixed - mixed.T

    w = np.zeros(N_FEATURES)
    at = utilities(w)
    loss = at.loss()
    for _ in range(steps):
        grad, curve = slopes(w, at)
        value, axis = np.linalg.eigh((curve + curve.T) / 2)
        move = -axis @ ((axis.T @ grad) / (np.maximum(value, 0) + ridge))
        gain = -float(grad @ move)
        if gain < 1e-7:
            break
        size = 1.0
        while size > 1e-3:
            there = utilities(w + size * move)
            now = there.loss() + ridge / 2 * float(((w + size * move) ** 2).sum())
            if now <= loss - 1e-4 * size * gain:
                break
            size /= 2
        else:
            break
        w, at, loss = w + size * move, there, now

    # Exact counts on a fine grid: the cuts between the two quantiles that err least; the best stretch's middle.
    edges = np.linspace(at.low, at.high, EDGES + 1)
    centre = (at.low + at.high) / 2

    def counts(parts):
        out, first, second = np.zeros((2, EDGES + 2)), 0.0, 0.0
        for x, y in parts:
            u = standard(x) @ w
            first, second = first + (u - centre).sum(), second + ((u - centre) ** 2).sum()
            for k in (0, 1):
                out[k] += np.bincount(np.searchsorted(edges, u[y == k], "right"), minlength=EDGES + 2)
        return np.concatenate((out.ravel(), [first, second]))

    got = _sum(_sweep(rows, counts))
    below = got[:-2].reshape(2, EDGES + 2).cumsum(1)[:, :-1]  # rows below each edge
    wrong = below[1] + bads - below[0]
    share = below.sum(0) / (goods + bads)
    inside = (share >= QUANTILES[0]) & (share <= QUANTILES[1])
    if not inside.any():  # one edge jumps over all of them
        inside = np.abs(share - QUANTILES[1]) == np.abs(share - QUANTILES[1]).min()
    best = edges[inside & (wrong == wrong[inside].min())]
    cut = float(best[len(best) // 2])
    n = goods + bads
    slope = 4.0 / max(1e-6, float(np.sqrt(max(0.0, got[-1] / n - (got[-2] / n) ** 2))))
    return Ranker(mean, scale, w, cut, slope)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS) -> Ranker:
    """Fit on all rows of ``labels`` outside fold 0."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", label)
    known = labels.select("doc_id", F.col(label).alias("y")).dropna().filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = known.count()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(known, n, 64), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([features(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, y double, x array<double>")
    # The same rows in the same order in each slice, however the tables lie: sums come out the same to the last bit.
    return fit(durable(got.repartition(n // SLICE + 1, "doc_id").sortWithinPartitions("doc_id")))


def with_score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All rows with quality_score (replacing a column of that name)."""
    require(docs, "text")
    rest = [c for c in docs.columns if c != "quality_score"]
    at = rest.index("text")
    taken = docs.select([F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t) for t in b.column(at).to_pylist()]) if b.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranker.score(x))], [*rest, "quality_score"])

    return taken.mapInArrow(run, StructType([*taken.schema.fields, StructField("quality_score", DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranker = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    scored = with_score(docs, ranker)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

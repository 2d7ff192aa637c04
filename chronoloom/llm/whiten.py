"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors become integers (``floor(SCALE * c)``), and each distinct one counts once.  Every
partition decomposes its rows block by block and keeps, whole and in full rank, the singular
values times the right vectors of its centred rows, its mean, its count and its exact sums.
Two such states merge by stacking both factors and one row more, the difference of the means
times ``sqrt(a * b / (a + b))``, and decomposing again: the covariance of the union without
loss, all dimensions kept, and never as a matrix of products, whose rounding would square.
Partitions merge by groups of ``FAN_IN`` in as many rounds as it takes; the driver receives
one state, whose size depends on the dimension alone.

Defined results: rows whose vector is null or empty or holds null or non-finite entries are
left out, so are rows whose vector isn't of the commonest length (of several, the shortest);
repeated rows each give their rows; a null vec_id stays null; without rows the result is empty.
A component without variance (fewer distinct vectors than dimensions) has null ``whitened``
and takes no part in ``identity_error``, which is null if there is no other; ``explained`` is
null if there is no variance at all.  A ``deviation`` beyond 64 bits is null.  Further columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, require

SCALE, COMPONENTS = 256, 4
#: Rows decomposed at once, and states merged in one group.
BLOCK, FAN_IN = 4096, 16
_SUMS = pa.list_(pa.decimal128(38, 0))
_STATE = "part bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, factor array<double>"


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows that take part."""
    require(vectors, id_col, vec_col)
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common[0] if common else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("x"))


@dataclass
class State:
    """Count, exact sums, mean, and singular values times right vectors of centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        safe = len(x) * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 63
        rows = x.astype(np.float64)
        mean = rows.mean(0)
        return cls(len(x), [int(s) for s in (x if safe else x.astype(object)).sum(0)], mean, _factor(rows - mean))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        apart = other.mean - self.mean
        stacked = np.vstack((self.factor, other.factor, apart * np.sqrt(self.n / n * other.n)))
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + apart * (other.n / n), _factor(stacked))

    def batch(self, part: int) -> pa.RecordBatch:
        cols = [pa.array([part]), pa.array([self.n]), pa.array([[Decimal(s) for s in self.sums]], _SUMS), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([self.factor.ravel()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, ["part", "n", "sums", "mean", "factor"])


def _factor(rows: np.ndarray) -> np.ndarray:
    s, vt = np.linalg.svd(rows, full_matrices=False)[1:]
    return s[:, None] * vt


def _states(table: pa.Table | pa.RecordBatch) -> Iterator[State]:
    for n, sums, mean, factor in zip(*(table.column(c).to_pylist() for c in ("n", "sums", "mean")), table.column("factor"), strict=True):
        yield State(n, [int(s) for s in sums], np.array(mean), np.array(factor.values).reshape(-1, len(mean)))


def _all(states: Iterator[State]) -> State | None:
    whole = None
    for s in states:
        whole = s if whole is None else whole.merged(s)
    return whole


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            x = b.column(column).slice(at, BLOCK)
            yield np.array(x.flatten()).reshape(len(x), -1)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # variances, falling
    vectors: np.ndarray  # a component a row

    @property
    def rank(self) -> int:
        floor = (self.values[0] if len(self.values) else 0.0) * (max(self.n, len(self.values)) * np.finfo(np.float64).eps) ** 2
        return int((self.values > floor).sum())

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S for each row, as integers, and divided by n."""
        top = max(abs(int(x.min())), abs(int(x.max())), 1)
        safe = self.n * top + max(map(abs, self.sums)) < 1 << 62
        apart = self.n * (x if safe else x.astype(object)) - np.array(self.sums, np.int64 if safe else object)
        return apart, apart.astype(np.float64) / self.n

    def project(self, centred: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` components of unit variance; NaN where there is no variance."""
        k = min(count, self.rank)
        out = np.full((len(centred), min(count, len(self.values))), np.nan)
        out[:, :k] = centred @ self.vectors[:k].T / np.sqrt(self.values[:k])
        return out


def _deviation(apart: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly."""
    if apart.dtype != object and float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2.0**62:
        return (apart * apart).sum(1).tolist()
    return [v if (v := sum(int(a) ** 2 for a in row)) < 1 << 63 else None for row in apart]


def fit(distinct: DataFrame) -> Whitening | None:
    """The whitening of the rows' ``x``; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = 0, None
        for b in batches:
            if b.num_rows:
                part, own = b.column(0)[0].as_py(), _all(map(State.of, _blocks(iter([b]), 1)))
                whole = own if whole is None else whole.merged(own)
        if whole is not None:
            yield whole.batch(part)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_all(_states(table)).batch(key[0].as_py())])

    tasks = distinct.rdd.getNumPartitions()
    states = distinct.select(F.spark_partition_id().cast("bigint").alias("part"), "x").mapInArrow(run, _STATE)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        states = states.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(merge, _STATE)
    got = states.toArrow()  # one row of the size of the dimension's square
    if not got.num_rows:
        return None
    whole = next(_states(got.combine_chunks()))
    s, vt = np.linalg.svd(whole.factor)[1:]  # all dimensions, those without variance too
    values = np.zeros(len(vt))
    values[: len(s)] = s**2 / whole.n
    return Whitening(whole.n, whole.sums, values, vt)


def identity_error(distinct: DataFrame, found: Whitening, count: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the covariance of the whitened ``distinct`` rows less the identity, from the rows themselves."""
    k = min(count, found.rank)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in _blocks(batches, 0):
            w = found.project(found.centred(x)[1], k)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

    cells = distinct.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # at most count ** 2 rows
    return max(abs(r["v"] / found.n - (r["cell"] // k == r["cell"] % k)) for r in cells)


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row that takes part and each of the first ``count`` components."""
    rows = integers(vectors, id_col, vec_col, scale)
    distinct = durable(rows.select("x").distinct())
    found = fit(distinct)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, found, count)
    k, all_ = min(count, len(found.values)), float(found.values.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                m = part.num_rows
                apart, centred = found.centred(np.array(part.column(1).flatten()).reshape(m, -1))
                each = pa.array(np.repeat(np.arange(m), k))
                cols = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)),
                    pa.array(_deviation(apart), pa.int64()).take(each),
                    pa.array(found.project(centred, k).ravel(), from_pandas=True),
                    pa.array(np.tile(found.values[:k] / all_ if all_ else np.full(k, np.nan), m), from_pandas=True),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

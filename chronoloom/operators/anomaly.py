"""Anomaly detectors: fences and z-scores as windows, neighbour and density scores on blocks, kernels for each series where state is needed."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoloom.operators.align import over, with_stats
from chronoloom.operators.chunks import each_series
from chronoloom.session import durable

Cols = Sequence[str]


def n_sigma(df: DataFrame, by: Cols, column: str, k: float = 3.0) -> DataFrame:
    """``is_anomaly`` at or beyond mean +- k sample deviations."""
    m, s, x = F.col("_m"), F.col("_s"), F.col(column)
    got = with_stats(df, by, {"_m": F.avg(column), "_s": F.stddev_samp(column)})
    return got.withColumn("is_anomaly", F.coalesce((x <= m - k * s) | (x >= m + k * s), F.lit(False))).drop("_m", "_s")


def z_score(df: DataFrame, by: Cols, column: str, threshold: float = 2.5, two_sided: bool = True) -> DataFrame:
    """``{c}_zscore`` with the population deviation and ``{c}_isanomaly``; NULL values are no anomalies."""
    got = with_stats(df, by, {"_m": F.avg(column), "_s": F.stddev_pop(column)})
    out = got.withColumn(f"{column}_zscore", F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    size = F.abs(f"{column}_zscore") if two_sided else F.col(f"{column}_zscore")
    return out.withColumn(f"{column}_isanomaly", F.coalesce(size >= threshold, F.lit(False)))


def fences(df: DataFrame, by: Cols, columns: Cols, k: float = 1.5) -> DataFrame:
    """One row for each series: ``{c}_low``, ``{c}_high`` k interquartile ranges off the quartiles."""
    q = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns])
    out = [e for c in columns for e in ((F.col(c)[0] - k * (F.col(c)[1] - F.col(c)[0])).alias(f"{c}_low"), (F.col(c)[1] + k * (F.col(c)[1] - F.col(c)[0])).alias(f"{c}_high"))]
    return q.select(*by, *out)


def box_outliers(df: DataFrame, by: Cols, columns: Cols, more_than: int = 0, k: float = 1.5) -> DataFrame:
    """``n_out`` (columns beyond their fences) and ``is_anomaly`` where there are more than given."""
    edge = fences(df, by, columns, k)
    wide = df.join(edge, list(by)) if by else df.crossJoin(F.broadcast(edge))  # without series the fences are one row
    n = sum((F.coalesce(((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return wide.select(*df.columns, n.alias("n_out"), (n > more_than).alias("is_anomaly"))


def winsorize(df: DataFrame, columns: Cols, least_distinct: int = 10, k: float = 1.5) -> DataFrame:
    """Columns of enough distinct values are capped at their upper fence."""
    edge = fences(df, [], columns, k).crossJoin(df.agg(*[F.count_distinct(c).alias(f"{c}_n") for c in columns]))  # one row each
    wide = df.crossJoin(F.broadcast(edge))
    return wide.select(*[(F.when((F.col(f"{c}_n") >= least_distinct) & (F.col(c) > F.col(f"{c}_high")), F.col(f"{c}_high")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in df.columns])


def beyond(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter((F.col(column) < low) | (F.col(column) > high))


def residual_z(df: DataFrame, by: Cols, x: str, y: str, sigma: float = 3.0) -> DataFrame:
    """Rows with the residual of the simple regression of y on x, its z-score and flag."""
    got = with_stats(df, by, {"_b": F.try_divide(F.covar_samp(y, x), F.var_samp(x)), "_x": F.avg(x), "_y": F.avg(y)})
    res = got.withColumn("residual", F.col(y) - (F.col("_y") + F.col("_b") * (F.col(x) - F.col("_x")))).drop("_b", "_x", "_y")
    got = with_stats(res, by, {"_s": F.stddev_samp("residual")})
    return got.withColumn("residual_z", F.try_divide(F.col("residual"), F.col("_s"))).drop("_s").withColumn("is_anomaly", F.coalesce(F.abs("residual_z") > sigma, F.lit(False)))


def _band(df: DataFrame, by: Cols, order: Cols, column: str, smooth: Column, size: int, k: float) -> DataFrame:
    """Band of k residual deviations (over the window before the row) around a smooth value made of rows before it."""
    frame = over(by, order).rowsBetween(-size, -1)
    base = df.withColumn("smooth", smooth).withColumn("_e", F.col(column) - F.col("smooth"))
    s = F.when(F.count("_e").over(frame) == size, F.stddev_pop("_e").over(frame))
    out = base.withColumn("_s", s).withColumns({"low": F.col("smooth") - k * F.col("_s"), "high": F.col("smooth") + k * F.col("_s")})
    return out.withColumn("is_anomaly", F.coalesce((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")), F.lit(False))).drop("_e", "_s")


def mean_band(df: DataFrame, by: Cols, order: Cols, column: str, size: int, k: float = 2.0) -> DataFrame:
    frame = over(by, order).rowsBetween(-size, -1)
    return _band(df, by, order, column, F.when(F.count(column).over(frame) == size, F.avg(column).over(frame)), size, k)


def exponential_band(df: DataFrame, by: Cols, order: Cols, column: str, size: int, alpha: float = 0.4, k: float = 2.0) -> DataFrame:
    """Smooth value: weights alpha (1 - alpha)^i over the ``size`` rows before, scaled to one."""
    w = over(by, order)
    weights = [alpha * (1 - alpha) ** i for i in range(size)]
    smooth = sum((F.lag(column, i + 1).over(w) * (x / sum(weights)) for i, x in enumerate(weights)), F.lit(0.0))
    return _band(df, by, order, column, smooth, size, k)


def seasonal_band(df: DataFrame, by: Cols, order: Cols, column: str, period: int, k: float = 2.5) -> DataFrame:
    """Moving average of a period plus the mean deviation of the position in the period; the band is of all residuals."""
    w = over(by, order)
    base = df.withColumns({"_p": (F.row_number().over(w) - 1) % period, "trend": F.avg(column).over(w.rowsBetween(1 - period, 0))})
    base = base.withColumn("season", F.avg(F.col(column) - F.col("trend")).over(Window.partitionBy(*by, "_p")))
    base = base.withColumn("smooth", F.col("trend") + F.col("season")).withColumn("_e", F.col(column) - F.col("smooth"))
    s = F.stddev_pop("_e").over(Window.partitionBy(*by))
    return base.withColumn("is_anomaly", F.coalesce(F.abs("_e") > k * s, F.lit(False))).drop("_p", "_e")


def shifting_kernel(y: np.ndarray, period: int, k: float) -> dict[str, np.ndarray]:
    """Steps up to the next anomaly are made together, since nothing that they look back on changes before it."""
    y = y.copy()
    flag, smooth = np.zeros(len(y), bool), np.full(len(y), np.nan)
    i, ahead = 2 * period, period
    while i < len(y):
        past = np.lib.stride_tricks.sliding_window_view(y[i - 2 * period : min(i + ahead, len(y)) - 1], 2 * period)
        now, last = y[i : i + len(past)], past[:, period:].mean(1)
        guess = last + (past[:, period] + past[:, 0] - past[:, :period].mean(1) - last) / 2
        odd = np.isnan(now) | (np.abs(now - guess) > k * past.std(1))
        n = int(odd.argmax()) + 1 if odd.any() else len(now)
        smooth[i : i + n] = guess[:n]
        i += n
        if odd[n - 1]:
            flag[i - 1] = not np.isnan(y[i - 1])
            y[i - 1] = guess[n - 1]
        ahead = period if odd[n - 1] else min(2 * ahead, 4096)
    return {"smooth": smooth, "is_anomaly": flag}


def shifting_band(df: DataFrame, by: Cols, order: str, column: str, period: int, k: float = 4.0) -> DataFrame:
    """As a seasonal forecast from the last two periods, with each anomaly replaced by its forecast before the next step."""
    return each_series(df, by, order, column, lambda y: shifting_kernel(y, period, k), "smooth double, is_anomaly boolean")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def neighbours(df: DataFrame, by: Cols, key: str, column: str, k: int) -> DataFrame:
    """(by, key, distance, n): each row's k nearest in one dimension, which are among the k before and after it in sorted order."""
    w = Window.partitionBy(*by).orderBy(column, key)
    near = F.array(*[F.abs(F.col(column) - f(column, i).over(w)) for i in range(1, k + 1) for f in (F.lag, F.lead)])
    sorted_ = F.slice(F.array_sort(F.filter(near, lambda x: x.isNotNull())), 1, k)
    return df.withColumn("_d", sorted_).select(*by, key, F.posexplode("_d").alias("n", "distance")).withColumn("n", F.col("n") + 1)


def knn_distance(df: DataFrame, by: Cols, key: str, column: str, k: int) -> DataFrame:
    """(by, key, knn_mean, knn_max)."""
    return neighbours(df, by, key, column, k).groupBy(*by, key).agg(F.avg("distance").alias("knn_mean"), F.max("distance").alias("knn_max"))


#: Query rows broadcast at once, or held in one part.
QUERY_BLOCK = 20_000
#: Rows of a block of vectors, query rows compared with it at once, and pairs whose distance is computed at once.
VECTOR_BLOCK, BATCH, PAIRS = 4096, 512, 1 << 15


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, k, v): blocks of keys and of their vectors, all of length n; -1 for vectors that are null or hold nulls, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vectors = b.columns
            size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            x, kind = flat.to_numpy(zero_copy_only=False), size.copy()
            kind[np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
            for n in np.unique(kind):
                at = np.flatnonzero(kind == n)
                for i in range(0, len(at), VECTOR_BLOCK):
                    j = at[i : i + VECTOR_BLOCK]
                    held = x[first[j][:, None] + np.arange(max(n, 0))].astype(float).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(j)], pa.int32()), keys.take(pa.array(j))), pa.array([held], pa.binary())], ["n", "k", "v"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.repartition("k").mapInArrow(run, f"n int, k array<{kind}>, v binary")


class _Nearest:
    """The ``k`` smallest squared distances of the queries of one block from all rows that they have met."""

    def __init__(self, keys: list, x: np.ndarray, k: int):
        self.keys, self.x, self.k = keys, x, k
        self.at: dict = {}
        for i, q in enumerate(keys):
            self.at.setdefault(q, []).append(i)
        self.size = (x * x).sum(1)
        self.plain = self.size < 1e150  # neither infinite, nor not a number, nor about to overflow
        self.best, self.n, self.others = np.full((len(keys), k), np.nan), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)

    def meet(self, keys: list, n: int, x: np.ndarray) -> None:
        """Products of matrices give a lower bound of each squared distance; those that may be among the nearest are computed from the differences."""
        own = [(i, j) for j, q in enumerate(keys) if q in self.at for i in self.at[q]]
        own_q, own_x = (np.array(a, np.int64) for a in (zip(*own, strict=True) if own else ((), ())))
        others = len(keys) - np.bincount(own_q, minlength=len(self.keys))
        self.others |= others > 0
        if n != self.x.shape[1] or n < 0:
            return
        self.n += others
        size = (x * x).sum(1)
        plain, slack = size < 1e150, 4 * (n + 8) * np.finfo(float).eps
        for a in range(0, len(self.keys), BATCH):
            part = slice(a, a + BATCH)
            low = self.x[part] @ x.T
            low *= -2
            low += (1 - slack) * size
            low += (1 - slack) * self.size[part, None]
            low[:, ~plain] = low[~self.plain[part]] = -np.inf  # computed in any case
            mine = (own_q >= a) & (own_q < a + BATCH)
            low[own_q[mine] - a, own_x[mine]] = np.nan
            limit = self.best[part, -1]
            if (new := np.flatnonzero(np.isnan(limit))).size and low.shape[1] > self.k:
                near = np.argpartition(low[new], self.k - 1, axis=1)[:, : self.k]  # not a number comes last
                limit[new] = (np.take_along_axis(low[new], near, 1) + 2 * slack * (size[near] + self.size[part][new, None])).max(1)
            limit = np.where(np.isfinite(limit), limit * (1 + 1e-12), np.inf)
            i, j = np.nonzero((low <= limit[:, None]) & (self.best[part, -1] != 0)[:, None])
            for f in range(0, len(i), PAIRS):
                self._add(i[f : f + PAIRS] + a, ((self.x[i[f : f + PAIRS] + a] - x[j[f : f + PAIRS]]) ** 2).sum(1))

    def _add(self, i: np.ndarray, d: np.ndarray) -> None:
        rows = np.unique(i)
        i, d = np.concatenate((np.repeat(rows, self.k), i)), np.concatenate((self.best[rows].ravel(), d))
        order = np.lexsort((d, i))
        i, d = i[order], d[order]
        self.best[rows] = d[np.arange(len(i)) - np.searchsorted(i, i) < self.k].reshape(-1, self.k)

    def rows(self) -> tuple[list, list]:
        """The queries that have met another row, and their distances; an empty list if none is known."""
        at = np.flatnonzero(self.others)
        d = np.sqrt(self.best)
        return [self.keys[i] for i in at], [d[i, : self.n[i]].tolist() for i in at]


def vector_knn(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, knn_mean, knn_max) of a stated set of query rows against all rows of another key.

    Both sides become blocks of vectors, and each block of rows meets each block of queries. The queries are broadcast up to QUERY_BLOCK
    rows, else dealt into parts of so many. A task returns the k nearest of what it has met; a distance from a null, from a
    vector with nulls or from one of another length is unknown and comes last.
    """
    kind = df.schema[key].dataType
    count = queries.count()
    q = durable(_packed(queries, key, vector).coalesce(max(1, -(-count // QUERY_BLOCK))))
    q = q.select(F.monotonically_increasing_id().alias("id"), F.col("n").alias("qn"), F.col("k").alias("qk"), F.col("v").alias("qv"))
    met = _packed(df, key, vector).crossJoin(F.broadcast(q) if count <= QUERY_BLOCK else q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        vectors = lambda v, n, rows: np.frombuffer(v.as_buffer(), float).reshape(rows, max(n, 0)) if n > 0 else np.zeros((rows, 0))
        with np.errstate(all="ignore"):
            for b in batches:
                for i in range(b.num_rows):
                    n, keys, v, at, qn, qk, qv = (c[i] for c in b.columns)
                    n, at, qn, keys = n.as_py(), at.as_py(), qn.as_py(), keys.as_py()
                    if at not in held:
                        qk = qk.as_py()
                        held[at] = _Nearest(qk, vectors(qv, qn, len(qk)).copy(), k)
                    held[at].meet(keys, n if qn >= 0 else -1, vectors(v, n, len(keys)))
            for h in held.values():
                q, d = h.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q, arrow), pa.array(d, pa.list_(pa.float64()))], ["q", "d"])

    arrow = to_arrow_type(kind)
    got = met.mapInArrow(run, f"q {kind.simpleString()}, d array<double>").select("q", F.explode_outer("d").alias("d"))
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.asc_nulls_last("d")))
    return got.withColumn("n", n).filter(F.col("n") <= k).groupBy(F.col("q").alias(key)).agg(F.avg("d").alias("knn_mean"), F.max("d").alias("knn_max"))


def dbscan(df: DataFrame, by: Cols, key: str, columns: Cols, eps: float, least: int) -> DataFrame:
    """``cluster`` from 0 in order of the key, -1 for noise; each series is one (bounded) group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        x = pdf[list(columns)].to_numpy(float)
        order = np.argsort(x[:, 0], kind="stable")
        first = x[order, 0]
        near: list[np.ndarray] = []
        for i in range(len(x)):  # only rows within eps in the first column can be near
            lo, hi = np.searchsorted(first, x[i, 0] - eps, "left"), np.searchsorted(first, x[i, 0] + eps, "right")
            at = order[lo:hi]
            near.append(at[np.sqrt(((x[at] - x[i]) ** 2).sum(1)) <= eps])
        label, n = np.full(len(x), -1), 0
        core = np.array([len(v) >= least for v in near])
        for i in range(len(x)):
            if core[i] and label[i] < 0:
                stack = [i]
                label[i] = n
                while stack:
                    for j in near[stack.pop()]:
                        if label[j] < 0:
                            label[j] = n
                            if core[j]:
                                stack.append(int(j))
                n += 1
        return pdf.assign(cluster=label)

    return df.groupBy(*by).applyInPandas(run, f"{_ddl(df)}, cluster int")


def dbscan_core(df: DataFrame, by: Cols, key: str, column: str, eps: float, least: int) -> DataFrame:
    """(by, key, n_near, is_core) in one dimension: a range frame counts the rows within eps, with no join."""
    part = ", ".join(f"`{c}`" for c in by)
    n = F.expr(f"count(1) OVER (PARTITION BY {part} ORDER BY CAST(`{column}` AS double) RANGE BETWEEN {float(eps)!r}D PRECEDING AND {float(eps)!r}D FOLLOWING)")
    return df.select(*by, key, n.alias("n_near"), (n >= least).alias("is_core"))


def density(df: DataFrame, by: Cols, key: str, column: str, kind: str = "lof", k: int = 20) -> DataFrame:
    """``score`` of a series' values by ``lof``, ``cof`` or ``sos``; each series is one (bounded) group, and of equally near values the earlier by key counts."""
    kernel = {"lof": _lof, "cof": _cof, "sos": _sos}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pdf.assign(score=kernel(pdf[column].to_numpy(float), k))

    return df.groupBy(*by).applyInPandas(run, f"{_ddl(df)}, score double")


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest others of each value, which are among the k before and after it in sorted order."""
    n, k = len(x), min(k, len(x) - 1)
    order = np.argsort(x, kind="stable")
    to = np.arange(n)[:, None] + np.r_[-k:0, 1 : k + 1]
    at = order[to.clip(0, n - 1)]
    d = np.where((to >= 0) & (to < n), np.abs(x[at] - x[order][:, None]), np.inf)
    best = np.lexsort((at, d), axis=1)[:, :k]
    back = np.argsort(order)
    return np.take_along_axis(at, best, 1)[back], np.take_along_axis(d, best, 1)[back]


def _lof(x: np.ndarray, k: int) -> np.ndarray:
    if len(x) < 3:
        return np.ones(len(x))
    at, d = _nearest(x, k)
    reach = np.maximum(d[at, -1], d)
    lrd = 1 / np.maximum(reach.mean(1), 1e-10)
    return lrd[at].mean(1) / lrd


def _cof(x: np.ndarray, k: int) -> np.ndarray:
    if len(x) < 3:
        return np.ones(len(x))
    at, _ = _nearest(x, k)
    chain = np.empty(len(x))
    for i in range(len(x)):
        left, path, cost = x[at[i]].tolist(), [x[i]], []
        while left:
            gap = [min(abs(v - p) for p in path) for v in left]
            j = int(np.argmin(gap))
            cost.append(gap[j])
            path.append(left.pop(j))
        n = len(cost)
        chain[i] = sum(2 * (n + 1 - r) / (n * (n + 1)) * c for r, c in enumerate(cost, 1))
    return chain / np.maximum(chain[at].mean(1), 1e-10)


def _sos(x: np.ndarray, perplexity: int) -> np.ndarray:
    n = len(x)
    if n < 3:
        return np.zeros(n)
    d = (x[:, None] - x[None, :]) ** 2
    bind = np.zeros((n, n))
    for i in range(n):
        own, low, high, beta = np.delete(d[i], i), 0.0, math.inf, 1.0
        for _ in range(60):
            p = np.exp(-(own - own.min()) * beta)
            h = math.log(p.sum()) + beta * float(((own - own.min()) * p).sum() / p.sum())
            if abs(h - math.log(min(perplexity, n - 1))) < 1e-6:
                break
            low, high = (beta, high) if h > math.log(min(perplexity, n - 1)) else (low, beta)
            beta = beta * 2 if high == math.inf else (low + high) / 2
        bind[i, np.arange(n) != i] = p / p.sum()
    return np.prod(1 - bind, axis=0)


def student_t_quantile(p: float, dof: float) -> float:
    """By bisection on the regularised incomplete beta function (continued fraction)."""

    def beta_share(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_share(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        c, d, f = 1.0, 0.0, 1.0
        for i in range(200):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return front * (f - 1)

    def cdf(t: float) -> float:
        tail = 0.5 * beta_share(dof / 2, 0.5, dof / (dof + t * t))
        return 1 - tail if t > 0 else tail

    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def grubbs_outliers(x: Sequence[float], alpha: float = 0.05, side: str = "both") -> list[int]:
    """Positions that the repeated Grubbs test removes, in order; ``side`` is both, min or max."""
    left, out = list(range(len(x))), []
    while len(left) > 2:
        v = np.array([x[i] for i in left], float)
        s = v.std(ddof=1)
        if not s > 0:
            break
        dev = {"both": np.abs(v - v.mean()), "max": v - v.mean(), "min": v.mean() - v}[side]
        n, j = len(v), int(np.argmax(dev))
        t = student_t_quantile(1 - alpha / (n * (2 if side == "both" else 1)), n - 2)
        if dev[j] / s <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        out.append(left.pop(j))
    return out


def grubbs(df: DataFrame, by: Cols, order: str, column: str, alpha: float = 0.05, side: str = "both") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        flag = np.zeros(len(pdf), bool)
        flag[grubbs_outliers(pdf[column].tolist(), alpha, side)] = True
        return pdf.assign(is_anomaly=flag)

    return df.groupBy(*by).applyInPandas(run, f"{_ddl(df)}, is_anomaly boolean")


def isolation_forest(df: DataFrame, by: Cols, columns: Cols, trees: int = 100, size: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """``score`` (near 1: isolated early) and ``is_anomaly`` for the share ``contamination``, for each series."""

    def path(x: np.ndarray, rows: np.ndarray, depth: int, top: int, draw: np.random.Generator, out: np.ndarray, among: np.ndarray) -> None:
        def normal(n: int) -> float:
            return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

        if depth >= top or len(rows) < 2:
            out[among] += depth + normal(len(rows))
            return
        f = int(draw.integers(x.shape[1]))
        low, high = x[rows, f].min(), x[rows, f].max()
        if low == high:
            out[among] += depth + normal(len(rows))
            return
        cut = draw.uniform(low, high)
        for side in (True, False):
            part = among[(x[among, f] < cut) == side]
            if len(part):
                path(x, rows[(x[rows, f] < cut) == side], depth + 1, top, draw, out, part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(columns)].to_numpy(float)
        draw, n = np.random.default_rng(seed), min(size, len(x))
        total = np.zeros(len(x))
        for _ in range(trees):
            path(x, draw.choice(len(x), n, replace=False), 0, max(1, math.ceil(math.log2(max(2, n)))), draw, total, np.arange(len(x)))
        c = 2 * (math.log(max(2, n) - 1 or 1) + 0.5772156649) - 2 * (max(2, n) - 1) / max(2, n) if n > 2 else 1.0
        score = 2 ** (-(total / trees) / max(c, 1e-9))
        return pdf.assign(score=score, is_anomaly=score > np.quantile(score, 1 - contamination))

    return df.groupBy(*by).applyInPandas(run, f"{_ddl(df)}, score double, is_anomaly boolean")


def one_class(df: DataFrame, by: Cols, columns: Cols, nu: float = 0.05, features: int = 64, seed: int = 42) -> DataFrame:
    """One-class machine on random Fourier features of a Gaussian kernel: ``score`` and the share ``nu`` of lowest ones flagged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(columns)].to_numpy(float)
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        draw = np.random.default_rng(seed)
        z = np.sqrt(2 / features) * np.cos(x @ draw.standard_normal((x.shape[1], features)) + draw.uniform(0, 2 * np.pi, features))
        w, rho = z.mean(0), 0.0
        for t in range(1, 201):
            s = z @ w
            rho = np.quantile(s, nu)
            w = w - (w - z[s < rho].sum(0) / max(1, nu * len(z))) / (t + 10)
        s = z @ w
        return pdf.assign(score=s, is_anomaly=s < np.quantile(s, nu))

    return df.groupBy(*by).applyInPandas(run, f"{_ddl(df)}, score double, is_anomaly boolean")


def pca_scores(df: DataFrame, columns: Cols, major: int, share: float = 0.99) -> DataFrame:
    """``major_score``, ``minor_score`` (squared standard scores on the leading and remaining components), ``reconstruction`` (squared length off the leading ones) and ``is_anomaly`` beyond the quantile of either score.

    One aggregate gives the covariance; the rest is a projection.
    """
    p = len(columns)
    got = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a in columns for b in columns]).first()
    mean, cov = np.array(got[:p], float), np.array(got[p:], float).reshape(p, p)
    value, axis = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, axis = np.maximum(value[order], 1e-12), axis[:, order]
    comp = [sum((float(axis[i, j]) * (F.col(c) - float(mean[i])) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(p)]
    part = lambda js: sum((comp[j] * comp[j] / float(value[j]) for j in js), F.lit(0.0))
    out = df.withColumns({"major_score": part(range(major)), "minor_score": part(range(major, p)), "reconstruction": sum((comp[j] * comp[j] for j in range(major, p)), F.lit(0.0))})
    cut = out.agg(F.percentile("major_score", F.lit(share)).alias("_a"), F.percentile("minor_score", F.lit(share)).alias("_b"))
    return out.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", (F.col("major_score") > F.col("_a")) | (F.col("minor_score") > F.col("_b"))).drop("_a", "_b")  # one row


def mahalanobis(df: DataFrame, a: str, b: str) -> DataFrame:
    """``distance`` (squared) of two columns from their mean, by their covariance."""
    m = df.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"), F.covar_samp(a, b).alias("_c"))
    x, y = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    d = F.try_divide(F.col("_vb") * x * x - 2 * F.col("_c") * x * y + F.col("_va") * y * y, F.col("_va") * F.col("_vb") - F.col("_c") * F.col("_c"))
    return df.crossJoin(F.broadcast(m)).select(*df.columns, d.alias("distance"))  # one row


def window_alarm(df: DataFrame, by: Cols, time: str, column: str, step: str, mean_low: float, mean_high: float, var_high: float) -> DataFrame:
    from chronoloom.operators.aggregates import limits

    bucket = F.window(time, step).getField("start").alias(time)
    return df.groupBy(*by, bucket).agg(F.avg(column).alias("mean"), F.var_pop(column).alias("var"), limits(df, column, mean_low, mean_high, var_high).alias("alarm"))


def correlation_alarm(df: DataFrame, by: Cols, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(a, b).alias("corr")).withColumn("alarm", F.coalesce(F.col("corr") < threshold, F.lit(False)))


def kmeans_windows(df: DataFrame, by: Cols, order: Cols, column: str, window: int = 5, k: int = 2, share: float = 0.6, seed: int = 42) -> DataFrame:
    """``score``: distance of the last ``window`` values from the nearest centre fitted on the first ``share`` of each series' rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    w = over(by, order)
    vec = F.array(*[F.lag(column, i).over(w).cast("double") for i in reversed(range(window))])
    pos = F.percent_rank().over(w)
    rows = df.withColumns({"_w": vec, "_pos": pos}).filter(F.forall("_w", lambda x: x.isNotNull())).withColumn("features", array_to_vector("_w"))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(rows.filter(F.col("_pos") < share))
    apart = [F.sqrt(sum(((F.col("_w")[i] - float(c[i])) * (F.col("_w")[i] - float(c[i])) for i in range(window)), F.lit(0.0))) for c in model.clusterCenters()]
    return rows.select(*df.columns, (F.least(*apart) if len(apart) > 1 else apart[0]).alias("score"))


def combine_scores(df: DataFrame, scores: Cols, groups: int = 2) -> DataFrame:
    """Average, maximum, median, average of maxima and maximum of averages over standardised detector scores; groups are fixed runs of columns."""
    params = df.agg(*[e for c in scores for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    wide = df.crossJoin(F.broadcast(params))  # one row
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in scores]
    wide = wide.withColumn("_z", F.array(*z))
    size = -(-len(scores) // groups)
    parts = [F.slice("_z", i + 1, size) for i in range(0, len(scores), size)]
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    srt = F.array_sort("_z")
    n = len(scores)
    median = (F.element_at(srt, (n + 1) // 2) + F.element_at(srt, n // 2 + 1)) / 2
    return wide.select(*df.columns, mean(F.col("_z")).alias("average"), F.array_max("_z").alias("maximum"), median.alias("median"), mean(F.array(*[F.array_max(p) for p in parts])).alias("aom"), F.array_max(F.array(*[mean(p) for p in parts])).alias("moa"))



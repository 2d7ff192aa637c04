"""Resampling, profiles, quantiles, correlations, forecast metrics and residual diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def resample(df: DataFrame, by: Cols, time: str, step: str, **aggs: Column) -> DataFrame:
    """Aggregates of each step of each series; the step's start keeps the name of the time column."""
    bucket = F.window(time, step).getField("start").alias(time)
    return df.groupBy(*by, bucket).agg(*[a.alias(n) for n, a in aggs.items()])


def resample_month(df: DataFrame, by: Cols, time: str, column: str, tie: Cols = ()) -> DataFrame:
    """Mean and last value of each calendar month."""
    month = F.date_trunc("month", time).cast("timestamp_ntz").alias("month")
    return df.groupBy(*by, month).agg(F.avg(column).alias(f"{column}_mean"), F.max_by(column, F.struct(time, *tie)).alias(f"{column}_last"))


def profile(df: DataFrame, columns: Cols) -> DataFrame:
    """(column, n_missing, n_inf, low, high, n_unique) by one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.sum((x.isNull() | F.isnan(x)).cast("long")).alias("n_missing"), F.coalesce(F.sum((F.abs(x) == float("inf")).cast("long")), F.lit(0).cast("long")).alias("n_inf"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct(x).alias("n_unique")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def limits(df: DataFrame, column: str, mean_low: float, mean_high: float, var_high: float) -> Column:
    """Aggregate: whether the mean or the population variance leaves its limits."""
    return (F.avg(column) < mean_low) | (F.avg(column) > mean_high) | (F.var_pop(column) > var_high)


def quantiles(df: DataFrame, by: Cols, column: str, shares: Sequence[float]) -> DataFrame:
    """(by, q, value): exact, linearly interpolated."""
    got = df.groupBy(*by).agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("v"))
    return got.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("q"), F.col("v").alias("value"))).alias("x")).select(*by, "x.*")


def value_counts(df: DataFrame, columns: Cols, least: int = 1) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def pearson(df: DataFrame, columns: Cols) -> DataFrame:
    """(a, b, corr) for the pairs of columns, a before b, by one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def average_rank(df: DataFrame, by: Cols, column: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean; NULL stays unranked."""
    w = Window.partitionBy(*by).orderBy(column)
    same = Window.partitionBy(*by, column)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0))


def position_rank(df: DataFrame, by: Cols, order: Cols, name: str, size: int | None = None) -> DataFrame:
    """Position in the order from 0, divided by the group's size (or a fixed one)."""
    n = F.lit(size) if size else F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / n)


def spearman(df: DataFrame, by: Cols, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_ra"), by, b, "_rb")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"))


def inversions(v: np.ndarray) -> int:
    """Pairs of positions whose later value is strictly smaller, counted while sorted blocks are merged."""
    v, total, size = v.copy(), 0, 32
    for i in range(0, len(v), size):
        b = v[i : i + size]
        total += int(np.triu(b[:, None] > b[None, :], 1).sum())
        v[i : i + size] = np.sort(b)
    while size < len(v):
        for i in range(0, len(v), 2 * size):
            left, right = v[i : i + size], v[i + size : i + 2 * size]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            v[i : i + 2 * size] = np.sort(v[i : i + 2 * size], kind="stable")
        size *= 2
    return total


def kendall(df: DataFrame, by: Cols, a: str, b: str) -> DataFrame:
    """(by, tau): tau-b of each series over all its pairs of rows, by merge counting; NULLs are left out, a constant column gives NULL."""

    def ties(*columns: np.ndarray) -> int:
        n = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1].astype(object)
        return int((n * (n - 1) // 2).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["_a"].to_numpy(), pdf["_b"].to_numpy()
        y = y[np.lexsort((y, x))]
        x = np.sort(x)
        pairs, tx, ty = len(x) * (len(x) - 1) // 2, ties(x), ties(y)
        apart = math.sqrt(pairs - tx) * math.sqrt(pairs - ty)
        agree = pairs - tx - ty + ties(x, y) - 2 * inversions(y)
        return pdf[list(by)].head(1).assign(tau=agree / apart if apart else None)

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    rows = df.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).na.drop(subset=["_a", "_b"])
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}tau double")


def f_regression(df: DataFrame, features: Cols, target: str, top: int = 50) -> DataFrame:
    """(feature, f) by decreasing F statistic of the simple regressions."""
    got = df.agg(*[F.corr(c, target).alias(c) for c in features], F.count(target).alias("_n"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features]))
    f = F.try_divide(F.col("x.r") * F.col("x.r"), 1 - F.col("x.r") * F.col("x.r")) * (F.col("_n") - 2)
    return got.select(rows.alias("x"), "_n").select("x.feature", f.alias("f")).orderBy(F.desc("f"), "feature").limit(top)


def metrics(y: str, p: str) -> dict[str, Column]:
    """Aggregates: r2, mse, rmse, mae, mape (a zero counts as 0.01) and mape_accuracy."""
    e = F.col(y) - F.col(p)
    mape = F.avg(F.abs(e / F.when(F.col(y) == 0, 0.01).otherwise(F.col(y))))
    mse = F.avg(e * e)
    return {"r2": 1 - F.try_divide(mse, F.var_pop(y)), "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(e)), "mape": mape, "mape_accuracy": 1 - mape}


def metric_variants(y: str, p: str) -> dict[str, Column]:
    """Aggregates: MAPE over non-zero rows, the one that shifts a zero mean, SMAPE, mean error, and MAPE over the mean."""
    e = F.col(y) - F.col(p)
    shift = F.when(F.avg(y) == 0, 0.01).otherwise(0.0)
    return {
        "mape_nonzero": F.avg(F.when(F.col(y) != 0, F.abs(e / F.when(F.col(y) != 0, F.col(y))))),
        "mape_mean": F.try_divide(F.avg(F.abs(e)), F.abs(F.avg(y)) + shift),
        "smape": F.avg(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(p))),
        "mean_error": F.avg(e),
    }


def huber(y: str, p: str, delta: float = 1.0) -> Column:
    e = F.abs(F.col(y) - F.col(p))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def with_mean_row(scores: DataFrame, label: str, columns: Cols, name: str = "mean") -> DataFrame:
    """The scores and a last row with the mean of each column."""
    mean = scores.agg(*[F.avg(c).alias(c) for c in columns]).withColumn(label, F.lit(name))
    return scores.select(label, *columns).unionByName(mean.select(label, *columns))


def rank_sharpe(long: DataFrame, date: str, y: str, p: str) -> DataFrame:
    """Mean over population deviation of the daily rank correlations."""
    ic = spearman(long, [date], y, p)
    return ic.agg(F.count("rho").alias("days"), F.avg("rho").alias("mean_ic"), F.try_divide(F.avg("rho"), F.stddev_pop("rho")).alias("sharpe"))


def kl_divergence(df: DataFrame, p: str, q: str) -> DataFrame:
    total = df.agg(F.sum(p).alias("_sp"), F.sum(q).alias("_sq"))
    a, b = F.col(p) / F.col("_sp"), F.col(q) / F.col("_sq")
    return df.crossJoin(F.broadcast(total)).filter((F.col(p) > 0) & (F.col(q) > 0)).agg(F.sum(a * F.ln(a / b)).alias("kl"))  # the total is one row


def durbin_watson(df: DataFrame, by: Cols, order: Cols, residual: str) -> DataFrame:
    d = F.col(residual) - F.lag(residual).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_d", d).groupBy(*by).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(residual) * F.col(residual))).alias("dw"))


def ljung_box(acf: DataFrame, by: Cols, n: DataFrame) -> DataFrame:
    """Q over the lags of an autocorrelation table (by, lag, acf); ``n`` has the series' lengths."""
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    return acf.join(n, list(by)).groupBy(*by, "n").agg((F.first("n") * (F.first("n") + 2) * F.sum(term)).alias("q")).drop("n")


def row_stats(df: DataFrame, columns: Cols, prefix: str) -> DataFrame:
    """Mean and population deviation over columns of a row, missing ones left out."""
    xs = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size(xs)
    mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), n)
    var = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n)
    return df.select("*", mean.alias(f"{prefix}_mean"), F.sqrt(var).alias(f"{prefix}_std"))


def jarque_bera(df: DataFrame, by: Cols, column: str) -> DataFrame:
    n, s, k = F.count(column), F.skewness(column), F.kurtosis(column)
    return df.groupBy(*by).agg((n / 6.0 * (s * s + k * k / 4)).alias("jb"))

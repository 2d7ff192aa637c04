"""Deterministic terms: time steps, trends, seasons, periodogram, decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.align import over

Cols = Sequence[str]


def time_step(df: DataFrame, by: Cols, order: Cols, name: str = "t") -> DataFrame:
    return df.withColumn(name, F.row_number().over(over(by, order)) - 1)


def trend_terms(df: DataFrame, by: Cols, order: Cols, degree: int = 1, start: int = 1) -> DataFrame:
    """``const``, ``trend`` and ``trend_squared`` ..; out of sample, start after the sample's length."""
    t = F.row_number().over(over(by, order)) - 1 + start
    names = ["trend", "trend_squared", "trend_cubed"]
    return df.select("*", F.lit(1.0).alias("const"), *[F.pow(t.cast("double"), F.lit(d)).alias(names[d - 1]) for d in range(1, degree + 1)])


def linear_trend(df: DataFrame, by: Cols, order: Cols, column: str) -> DataFrame:
    """Rows with ``t``, the fitted ``trend`` and ``detrended``."""
    base = time_step(df, by, order)
    w = Window.partitionBy(*by)
    slope = F.try_divide(F.covar_pop(column, "t").over(w), F.var_pop("t").over(w))
    out = base.withColumn("trend", F.avg(column).over(w) + slope * (F.col("t") - F.avg("t").over(w)))
    return out.withColumn("detrended", F.col(column) - F.col("trend"))


def periodogram(df: DataFrame, by: Cols, order: Cols, column: str, frequencies: Sequence[int]) -> DataFrame:
    """(by, k, power): spectrum of the linearly detrended series at k cycles over its length, one aggregate for all."""
    base = linear_trend(df, by, order, column).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    angle = lambda k: 2 * F.pi() * k * F.col("t") / F.col("_n")
    aggs = [a for k in frequencies for a in (F.sum(F.col("detrended") * F.cos(angle(k))).alias(f"c{k}"), F.sum(F.col("detrended") * F.sin(angle(k))).alias(f"s{k}"))]
    got = base.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")) / (F.col("_n") * F.col("_n"))).alias("power")) for k in frequencies])
    return got.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def decompose(df: DataFrame, by: Cols, order: Cols, column: str, period: int) -> DataFrame:
    """``trend`` (centred mean over a period, halved ends if even), ``seasonal`` (mean of the position, centred) and ``rest``."""
    w = over(by, order)
    half = period // 2
    x = F.col(column)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        trend = F.when(F.count(column).over(frame) == period, F.avg(column).over(frame))
    else:
        a, b = w.rowsBetween(-half, half - 1), w.rowsBetween(1 - half, half)
        trend = F.when((F.count(column).over(a) == period) & (F.count(column).over(b) == period), (F.avg(column).over(a) + F.avg(column).over(b)) / 2)
    base = time_step(df, by, order, "_t").withColumn("trend", trend).withColumn("_p", F.col("_t") % period)
    raw = base.withColumn("_s", F.avg(x - F.col("trend")).over(Window.partitionBy(*by, "_p")))
    first = raw.filter(F.col("_t") < period).groupBy(*by).agg(F.avg("_s").alias("_m"))
    wide = raw.join(first, list(by)) if by else raw.crossJoin(F.broadcast(first))  # one row
    return wide.withColumn("seasonal", F.col("_s") - F.col("_m")).withColumn("rest", x - F.col("trend") - F.col("seasonal")).drop("_t", "_p", "_s", "_m")


def pacf(acf: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1 .., by the Durbin-Levinson recursion."""
    out: list[float] = []
    phi: list[float] = []
    for k in range(1, len(acf) + 1):
        num = acf[k - 1] - sum(p * acf[k - 2 - j] for j, p in enumerate(phi))
        den = 1 - sum(p * acf[j] for j, p in enumerate(phi))
        own = num / den if den else 0.0
        phi = [p - own * q for p, q in zip(phi, reversed(phi), strict=True)] + [own]
        out.append(own)
    return out


def kpss(df: DataFrame, by: Cols, order: Cols, column: str) -> DataFrame:
    """(by, kpss): level statistic without lag window: squared partial sums over n^2 times the variance."""
    w = Window.partitionBy(*by)
    base = df.withColumn("_e", F.col(column) - F.avg(column).over(w))
    base = base.withColumn("_s", F.sum("_e").over(over(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(F.lit(1))
    return base.groupBy(*by).agg(F.try_divide(F.sum(F.col("_s") * F.col("_s")), n * F.sum(F.col("_e") * F.col("_e"))).alias("kpss"))

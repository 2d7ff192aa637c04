"""Lag, rolling, expanding, difference and event features: each family is one projection, so one window pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoloom.operators.align import existing, over

Cols = Sequence[str]
STATS = ("mean", "std", "min", "max", "median", "skew", "kurt")


def lags(df: DataFrame, by: Cols, order: Cols, columns: Cols, steps: Sequence[int]) -> DataFrame:
    """``{c}_lag_{k}`` for every existing column and step."""
    w = over(by, order)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in existing(df, columns) for k in steps])


def targets(df: DataFrame, by: Cols, order: Cols, target: str, horizon: int, start: int = 0) -> DataFrame:
    """``{target}_shift_{h}``: the target h rows ahead."""
    w = over(by, order)
    return df.select("*", *[F.lead(target, h).over(w).alias(f"{target}_shift_{h}") for h in range(start, start + horizon)])


def target_array(df: DataFrame, by: Cols, order: Cols, target: str, horizon: int, name: str = "targets") -> DataFrame:
    """The next ``horizon`` values as an array, NULL near the end; one frame however long the horizon."""
    frame = over(by, order).rowsBetween(0, horizon - 1)
    values = F.collect_list(F.struct(target)).over(frame)
    return df.withColumn(name, F.when(F.size(values) == horizon, values[target]))


def statistic(stat: str, c: str, frame: WindowSpec) -> Column:
    """One of STATS over a frame; bias-corrected, as far as the frame has enough values, else NULL."""
    n = F.count(c).over(frame)
    if stat == "mean":
        return F.avg(c).over(frame)
    if stat == "std":
        return F.stddev_samp(c).over(frame)
    if stat in ("min", "max"):
        return getattr(F, stat)(c).over(frame)
    if stat == "median":
        return F.percentile(c, F.lit(0.5)).over(frame)
    if stat == "skew":
        return F.when(n >= 3, F.sqrt(n * (n - 1.0)) / F.greatest(n - 2, F.lit(1)) * F.skewness(c).over(frame))
    if stat == "kurt":
        m = F.greatest(n, F.lit(4))
        return F.when(n >= 4, (m - 1.0) / ((m - 2) * (m - 3)) * ((m + 1) * F.kurtosis(c).over(frame) + 6))
    raise ValueError(f"unknown statistic: {stat}")


def rolling(df: DataFrame, by: Cols, order: Cols, columns: Cols, sizes: Sequence[int], stats: Sequence[str] = STATS, closed: bool = True) -> DataFrame:
    """``{c}_rolling_{stat}_{w}`` over the last w rows; with ``closed`` false the frame ends before the row, which a forecast needs."""
    out = []
    for w in sizes:
        frame = over(by, order).rowsBetween(*((1 - w, 0) if closed else (-w, -1)))
        out += [statistic(s, c, frame).alias(f"{c}_rolling_{s}_{w}") for c in existing(df, columns) for s in stats]
    return df.select("*", *out)


def expanding(df: DataFrame, by: Cols, order: Cols, columns: Cols, stats: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    frame = over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[statistic(s, c, frame).alias(f"{c}_expanding_{s}") for c in existing(df, columns) for s in stats])


def wide_mean(df: DataFrame, by: Cols, order: Cols, column: str, size: int) -> DataFrame:
    """``{c}_rolling_mean_{w}`` by prefix sums: linear in the rows however wide the frame."""
    w = over(by, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumns({"_s": F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(run), "_n": F.count(column).over(run)})
    s, n = F.col("_s") - F.coalesce(F.lag("_s", size).over(w), F.lit(0.0)), F.col("_n") - F.coalesce(F.lag("_n", size).over(w), F.lit(0))
    return sums.withColumn(f"{column}_rolling_mean_{size}", F.when(n > 0, s / n)).drop("_s", "_n")


def diffs(df: DataFrame, by: Cols, order: Cols, columns: Cols, periods: Sequence[int] = (1, 7, 24)) -> DataFrame:
    w = over(by, order)
    return df.select("*", *[(F.col(c) - F.lag(c, p).over(w)).alias(f"{c}_diff_{p}") for c in existing(df, columns) for p in periods])


def pct_changes(df: DataFrame, by: Cols, order: Cols, columns: Cols, periods: Sequence[int] = (1, 7)) -> DataFrame:
    """``{c}_pct_change_{p}`` of the forward-filled column; NULL where the earlier value is zero."""
    w = over(by, order)
    cols = existing(df, columns)
    full = df.withColumns({f"_f_{c}": F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in cols})
    out = [(F.try_divide(F.col(f"_f_{c}"), F.lag(f"_f_{c}", p).over(w)) - 1).alias(f"{c}_pct_change_{p}") for c in cols for p in periods]
    return full.select(*df.columns, *out)


def time_since(df: DataFrame, by: Cols, order: Cols, column: str, events: Sequence[str] = ("peak", "trough")) -> DataFrame:
    """``{c}_time_since_{event}``: rows since the last strict local extreme before the row, or since the start."""
    w = over(by, order)
    x, a, b = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    marks = {"peak": (a < x) & (x > b), "trough": (a > x) & (x < b)}
    base = df.withColumns({"_p": F.row_number().over(w) - 1} | {f"_{e}": marks[e] for e in events})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = {e: F.last(F.when(F.col(f"_{e}"), F.col("_p")), True).over(before) for e in events}
    return base.select(*df.columns, *[F.coalesce(F.col("_p") - last[e], F.col("_p")).alias(f"{column}_time_since_{e}") for e in events])


def returns_and_volatility(df: DataFrame, by: Cols, order: Cols, price: str, volume: str, sizes: Sequence[int]) -> DataFrame:
    """``ret_w``, ``vol_w`` (deviation of w one-step returns, NULL before there are w) and ``volume_w`` (mean of w over mean of 2w)."""
    w = over(by, order)
    base = df.withColumn("_r", F.try_divide(F.col(price), F.lag(price).over(w)) - 1)
    out = []
    for k in sizes:
        own, twice = w.rowsBetween(1 - k, 0), w.rowsBetween(1 - 2 * k, 0)
        out += [
            (F.try_divide(F.col(price), F.lag(price, k).over(w)) - 1).alias(f"ret_{k}"),
            F.when(F.count("_r").over(own) == k, F.stddev_samp("_r").over(own)).alias(f"vol_{k}"),
            F.when(F.count(volume).over(twice) == 2 * k, F.try_divide(F.avg(volume).over(own), F.avg(volume).over(twice))).alias(f"volume_{k}"),
        ]
    return base.select(*df.columns, *out)


def breakouts(df: DataFrame, by: Cols, order: Cols, close: str, high: str, low: str) -> DataFrame:
    """Whether the close passes the last known high or low before it, as 0 or 1."""
    before = over(by, order).rowsBetween(Window.unboundedPreceding, -1)
    up = F.coalesce(F.col(close) > F.last(high, True).over(before), F.lit(False))
    down = F.coalesce(F.col(close) < F.last(low, True).over(before), F.lit(False))
    return df.select("*", up.cast("int").alias("break_high"), down.cast("int").alias("break_low"))


def price_spreads(df: DataFrame, by: Cols, order: Cols, prices: Cols = ("close", "open", "high", "low"), settlement: str = "sprice", volume: str = "volume", interest: str = "interest") -> DataFrame:
    """``{a}_{b}`` = a/b - 1 for names a > b, ``open_gap`` over the previous close, settlement change and premium, volume by interest."""
    w = over(by, order)
    pairs = [(a, b) for a in prices for b in prices if a > b]
    return df.select(
        "*",
        *[(F.try_divide(F.col(a), F.col(b)) - 1).alias(f"{a}_{b}") for a, b in pairs],
        (F.try_divide(F.col("open"), F.lag("close").over(w)) - 1).alias("open_gap"),
        (F.try_divide(F.col(settlement), F.lag(settlement).over(w)) - 1).alias("settle_change"),
        (F.try_divide(F.col("close"), F.col(settlement)) - 1).alias("premium"),
        F.try_divide(F.col(volume), F.col(interest)).alias("turnover"),
    )


def forward_log_returns(df: DataFrame, by: Cols, order: Cols, price: str, leads: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """``label_k`` = -ln(price k+1 ahead / price 1 ahead)."""
    w = over(by, order)
    return df.select("*", *[(-F.ln(F.try_divide(F.lead(price, 1 + k).over(w), F.lead(price, 1).over(w)))).alias(f"label_{k}") for k in leads])


def centered_mean(df: DataFrame, by: Cols, order: Cols, column: str, size: int, least: int, name: str = "trend") -> DataFrame:
    frame = over(by, order).rowsBetween(-(size // 2), size - 1 - size // 2)
    return df.withColumn(name, F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame)))


def make_lags(df: DataFrame, by: Cols, order: Cols, column: str, n: int, lead_time: int = 1) -> DataFrame:
    w = over(by, order)
    return df.select("*", *[F.lag(column, i).over(w).alias(f"y_lag_{i}") for i in range(lead_time, n + lead_time)])


def make_steps(df: DataFrame, by: Cols, order: Cols, column: str, steps: int) -> DataFrame:
    """``y_step_{i}`` from 1: the value i - 1 rows ahead."""
    w = over(by, order)
    return df.select("*", *[F.lead(column, i).over(w).alias(f"y_step_{i + 1}") for i in range(steps)])


def embed(df: DataFrame, by: Cols, order: Cols, columns: Cols, n_lags: int, horizon: int) -> DataFrame:
    """Time-delay embedding ``{c}(t-k)`` .. ``{c}(t)`` .. ``{c}(t+h)``, complete rows only."""
    w = over(by, order)
    name = lambda c, k: f"{c}(t)" if k == 0 else f"{c}(t{k:+d})"
    out = [F.lead(c, k).over(w).alias(name(c, k)) for k in range(-n_lags, horizon) for c in columns]
    wide = df.select(*by, *order, *out)
    return wide.filter(" AND ".join(f"`{name(c, k)}` IS NOT NULL" for k in range(-n_lags, horizon) for c in columns))


def chained_shifts(df: DataFrame, by: Cols, order: Cols, columns: Cols, n: int) -> DataFrame:
    """``goal`` (the first column) and ``a1`` .. : values of each column 1 .. n rows before."""
    w = over(by, order)
    past = [F.lag(c, k + 1).over(w) for c in columns for k in range(n)]
    return df.select(*by, *order, F.col(columns[0]).alias("goal"), *[p.alias(f"a{i}") for i, p in enumerate(past, 1)])


def seasonal_changes(df: DataFrame, by: Cols, order: Cols, column: str, season: int, year: int) -> DataFrame:
    """``sdiff``, ``yoy`` and ``log_diff`` of a column."""
    w = over(by, order)
    x = F.col(column)
    return df.select("*", (x - F.lag(x, season).over(w)).alias("sdiff"), (F.try_divide(x, F.lag(x, year).over(w)) - 1).alias("yoy"), (F.ln(x) - F.ln(F.lag(x).over(w))).alias("log_diff"))


def lag_correlation(df: DataFrame, by: Cols, order: Cols, column: str, steps: Sequence[int]) -> DataFrame:
    """(by, lag, corr, acf): Pearson of the pairs, and autocovariance around the whole mean over the whole variance."""
    w = over(by, order)
    whole = Window.partitionBy(*by)
    base = df.select(*by, F.col(column).alias("_y"), (F.col(column) - F.avg(column).over(whole)).alias("_d"), *[F.lag(column, k).over(w).alias(f"_l{k}") for k in steps])
    wide = base.withColumns({f"_e{k}": F.col(f"_l{k}") - F.avg("_y").over(whole) for k in steps})
    aggs = [a for k in steps for a in (F.corr("_y", f"_l{k}").alias(f"c{k}"), F.try_divide(F.sum(F.col("_d") * F.col(f"_e{k}")), F.sum(F.col("_d") * F.col("_d"))).alias(f"a{k}"))]
    got = wide.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("corr"), F.col(f"a{k}").alias("acf")) for k in steps]))
    return got.select(*by, rows.alias("x")).select(*by, "x.*")

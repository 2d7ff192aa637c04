"""Statistical forecasting: exponential smoothing as folds over arrays, autoregressions by least squares, kernels for each series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def series_array(df: DataFrame, by: Cols, column: str, name: str = "ys") -> DataFrame:
    """(by, ys): a series' values in time order; for series that fit a row."""
    rows = F.array_sort(F.collect_list(F.struct("time", F.col(column).cast("double").alias("v"))))
    return df.groupBy(*by).agg(rows.alias("_r")).select(*by, F.transform("_r", lambda r: r["v"]).alias(name))


def ses(df: DataFrame, by: Cols, column: str, alphas: Sequence[float]) -> DataFrame:
    """(by, alpha, level, mae): simple exponential smoothing from the first value, one-step errors."""
    a = series_array(df, by, column).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alphas])))
    state = F.struct(F.col("ys")[0].alias("l"), F.lit(0.0).alias("e"))
    step = lambda s, y: F.struct((s["l"] + F.col("alpha") * (y - s["l"])).alias("l"), (s["e"] + F.abs(y - s["l"])).alias("e"))
    got = a.withColumn("_s", F.aggregate(F.expr("slice(ys, 2, greatest(size(ys) - 1, 0))"), state, step))
    return got.select(*by, "alpha", F.col("_s.l").alias("level"), F.try_divide(F.col("_s.e"), F.size("ys") - 1).alias("mae"))


def best_ses(df: DataFrame, by: Cols, column: str, alphas: Sequence[float]) -> DataFrame:
    got = ses(df, by, column, alphas)
    return got.groupBy(*by).agg(F.min_by(F.struct("alpha", "level", "mae"), F.struct("mae", "alpha")).alias("b")).select(*by, "b.*")


def holt(df: DataFrame, by: Cols, column: str, alpha: float, beta: float) -> DataFrame:
    """(by, level, trend, mae) of double exponential smoothing, started by the first two values."""
    a = series_array(df, by, column).filter(F.size("ys") >= 2)
    state = F.struct(F.col("ys")[0].alias("l"), (F.col("ys")[1] - F.col("ys")[0]).alias("b"), F.lit(0.0).alias("e"))

    def step(s, y):
        level = alpha * y + (1 - alpha) * (s["l"] + s["b"])
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * s["b"]).alias("b"), (s["e"] + F.abs(y - s["l"] - s["b"])).alias("e"))

    got = a.withColumn("_s", F.aggregate(F.expr("slice(ys, 2, size(ys) - 1)"), state, step))
    return got.select(*by, F.col("_s.l").alias("level"), F.col("_s.b").alias("trend"), (F.col("_s.e") / (F.size("ys") - 1)).alias("mae"))


def holt_winters_kernel(y: np.ndarray, m: int, alpha: float, beta: float, gamma: float, horizon: int) -> tuple[np.ndarray, float]:
    """Additive: the forecasts and the mean one-step error."""
    level, trend = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m if len(y) >= 2 * m else 0.0
    season, err = list(y[:m] - level), 0.0
    for t in range(m, len(y)):
        s = season[t - m]
        err += abs(y[t] - level - trend - s)
        new = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
        season.append(gamma * (y[t] - level) + (1 - gamma) * s)
    out = np.array([level + (h + 1) * trend + season[len(season) - m + h % m] for h in range(horizon)])
    return out, err / max(1, len(y) - m)


def croston_kernel(y: np.ndarray, horizon: int, alpha: float = 0.1) -> np.ndarray:
    size = gap = None
    since = 0
    for v in y:
        since += 1
        if v > 0:
            size, gap = (v, since) if size is None else (size + alpha * (v - size), gap + alpha * (since - gap))
            since = 0
    return np.full(horizon, 0.0 if size is None else size / gap)


def theta_kernel(y: np.ndarray, horizon: int, alphas: Sequence[float] = tuple(np.linspace(0.05, 0.95, 19))) -> np.ndarray:
    """Half the linear trend, half smoothing of the line of double curvature."""
    t = np.arange(len(y))
    slope, base = np.polyfit(t, y, 1) if len(y) > 1 else (0.0, y[0])
    z = 2 * y - (base + slope * t)

    def level(a: float) -> tuple[float, float]:
        x, e = z[0], 0.0
        for v in z[1:]:
            e += (v - x) ** 2
            x += a * (v - x)
        return e, x

    end = min((level(a) for a in alphas), key=lambda r: r[0])[1]
    h = np.arange(1, horizon + 1)
    return (base + slope * (len(y) - 1 + h) + end) / 2


def ar_design(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[1.0, *y[i - p : i][::-1]] for i in range(p, len(y))]), y[p:]


def ar_kernel(y: np.ndarray, horizon: int, orders: Sequence[int] = (1, 2, 3, 4, 5), criterion: str = "aic") -> tuple[np.ndarray, int]:
    """Autoregression of the order of least AIC or BIC; the forecasts and the order."""
    best = None
    top = max(orders)
    for p in orders:
        x, t = ar_design(y[top - p :], p)
        if len(x) <= p + 1:
            continue
        w = np.linalg.lstsq(x, t, rcond=None)[0]
        s2 = max(float(((t - x @ w) ** 2).mean()), 1e-300)
        score = len(t) * np.log(s2) + (p + 1) * (2 if criterion == "aic" else np.log(len(t)))
        if best is None or score < best[0]:
            best = score, p, w
    if best is None:
        return np.full(horizon, y[-1] if len(y) else np.nan), 0
    _, p, w = best
    v = list(y)
    for _ in range(horizon):
        v.append(float(w[0] + w[1:] @ np.array(v[-p:][::-1])))
    return np.array(v[len(y) :]), p


def adf_statistic(y: np.ndarray, k: int = 1) -> float:
    """t statistic of the level in the regression of differences with k lagged differences and a constant."""
    d = np.diff(y)
    n = len(d) - k
    if n < k + 4:
        return 0.0
    x = np.column_stack([np.ones(n), y[k:-1], *[d[k - i : len(d) - i] for i in range(1, k + 1)]])
    t = d[k:]
    w = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ w
    cov = e @ e / (n - x.shape[1]) * np.linalg.pinv(x.T @ x)
    return float(w[1] / np.sqrt(max(cov[1, 1], 1e-300)))


def differences_needed(y: np.ndarray, critical: float = -3.43, most: int = 2) -> int:
    """How often to difference until the statistic passes the 1 % value."""
    for d in range(most + 1):
        if adf_statistic(np.diff(y, d) if d else y) < critical:
            return d
    return most


def arima_kernel(y: np.ndarray, horizon: int, orders: Sequence[tuple[int, int]] = ((1, 0), (2, 0), (1, 1), (2, 1), (0, 1)), criterion: str = "bic") -> tuple[np.ndarray, tuple[int, int, int]]:
    """Difference until stationary, pick (p, q) by the criterion with Hannan-Rissanen fits, forecast, sum back."""
    d = differences_needed(y)
    z = np.diff(y, d) if d else np.asarray(y, float)
    mean = z.mean()
    c = z - mean
    long = min(10, max(2, len(c) // 10))
    x, t = ar_design(c, long)
    e = np.zeros(len(c))
    if len(x) > long + 1:
        e[long:] = t - x @ np.linalg.lstsq(x, t, rcond=None)[0]
    best = None
    for p, q in orders:
        start = max(p, q) + long
        if len(c) - start < p + q + 3:
            continue
        cols = [c[start - i : len(c) - i] for i in range(1, p + 1)] + [e[start - i : len(c) - i] for i in range(1, q + 1)]
        x = np.column_stack(cols)
        w = np.linalg.lstsq(x, c[start:], rcond=None)[0]
        r = c[start:] - x @ w
        score = len(r) * np.log(max(float((r**2).mean()), 1e-300)) + (p + q) * (2 if criterion == "aic" else np.log(len(r)))
        if best is None or score < best[0]:
            best = score, p, q, w, r
    if best is None:
        return np.full(horizon, y[-1]), (0, d, 0)
    _, p, q, w, r = best
    v, u = list(c), list(np.r_[np.zeros(len(c) - len(r)), r])
    for _ in range(horizon):
        v.append(float(sum(w[i] * v[-1 - i] for i in range(p)) + sum(w[p + i] * u[-1 - i] for i in range(q))))
        u.append(0.0)
    out = np.array(v[len(c) :]) + mean
    for k in range(d - 1, -1, -1):
        out = (np.diff(y, k)[-1] if k else y[-1]) + np.cumsum(out)
    return out, (p, d, q)


def stationary(coefficients: Sequence[float]) -> bool:
    """Whether the roots of 1 - c1 x - c2 x^2 .. lie outside the unit circle (for a moving average: invertible, with signs turned)."""
    roots = np.roots([*(-np.asarray(coefficients[::-1], float)), 1.0])
    return bool(np.all(np.abs(roots) > 1))


def prophet_kernel(y: np.ndarray, horizon: int, period: float, order: int = 3, changes: int = 10, penalty: float = 1.0) -> np.ndarray:
    """Piecewise-linear trend and Fourier seasonality by ridge regression."""
    n = len(y)
    t = np.arange(n + horizon) / max(1, n - 1)
    knots = np.linspace(0, 0.8, changes + 2)[1:-1]
    x = np.column_stack([np.ones_like(t), t, *[np.maximum(0, t - k) for k in knots], *[f(2 * np.pi * k * np.arange(n + horizon) / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]])
    d = np.full(x.shape[1], penalty)
    d[:2] = 1e-8
    known = ~np.isnan(y)
    w = np.linalg.solve(x[:n][known].T @ x[:n][known] + np.diag(d), x[:n][known].T @ y[known])
    return x[n:] @ w


#: Panel models by name: kernel(y, horizon, season) -> forecasts.
PANEL = {
    "seasonal_naive": lambda y, h, m: np.array([y[len(y) - m + i % m] for i in range(h)]) if len(y) >= m else np.full(h, y[-1]),
    "historic_average": lambda y, h, m: np.full(h, y.mean()),
    "naive": lambda y, h, m: np.full(h, y[-1]),
    "croston": lambda y, h, m: croston_kernel(y, h),
    "theta": lambda y, h, m: theta_kernel(y, h),
    "holt_winters": lambda y, h, m: min((holt_winters_kernel(y, m, a, b, g, h) for a in (0.2, 0.5, 0.8) for b in (0.05, 0.2) for g in (0.1, 0.4)), key=lambda r: r[1])[0],
    "ar": lambda y, h, m: ar_kernel(y, h)[0],
    "arima": lambda y, h, m: arima_kernel(y, h)[0],
    "prophet": lambda y, h, m: prophet_kernel(y, h, m),
}


def panel_forecast(df: DataFrame, by: Cols, column: str, models: Sequence[str], horizon: int, season: int, fallback: str = "naive", z: float = 1.645) -> DataFrame:
    """(by, model, step, predict_value, low, high): every model for every series; one that fails gives way to the fallback."""
    unknown = set(models) - set(PANEL)
    if unknown:
        raise ValueError(f"unknown models: {', '.join(sorted(unknown))}")
    names = list(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("time", kind="stable")[column].dropna().to_numpy(float)
        spread = float(np.std(y[season:] - y[:-season])) if len(y) > season else float(np.std(y)) if len(y) else 0.0
        parts = []
        for m in names:
            try:
                p = PANEL[m](y, horizon, season)
            except (ValueError, IndexError, np.linalg.LinAlgError):
                p = PANEL[fallback](y, horizon, season) if len(y) else np.full(horizon, np.nan)
            parts.append(pd.DataFrame({**{c: [pdf[c].iloc[0]] * horizon for c in by}, "model": m, "step": np.arange(1, horizon + 1, dtype=np.int32), "predict_value": p, "low": p - z * spread, "high": p + z * spread}))
        return pd.concat(parts)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, model string, step int, predict_value double, low double, high double")


def linear_var(df: DataFrame, by: Cols, columns: Cols, feature_lags: Sequence[int], horizon: int):
    """Regress each column's next ``horizon`` values on lags of all columns (0 is the current row); returns the model and its forecasts from each series' last row."""
    from chronoloom.operators.reshape import last_rows
    from chronoloom.operators.windows import lags
    from chronoloom.plans.learners import Ridge

    w = lags(df, by, ["time"], columns, feature_lags)
    from pyspark.sql import Window

    over = Window.partitionBy(*by).orderBy("time")
    outs = [f"{c}_next_{h}" for c in columns for h in range(1, horizon + 1)]
    wide = w.select("*", *[F.lead(c, h).over(over).alias(f"{c}_next_{h}") for c in columns for h in range(1, horizon + 1)])
    features = [f"{c}_lag_{k}" for c in columns for k in feature_lags]
    model = Ridge().fit(wide, features, outs)
    got = model.predict(last_rows(w, by, ["time"], 1))
    return model, got.select(*by, *[F.col(f"{o}_hat").alias(o) for o in outs])


def bayes_var_kernel(moments: np.ndarray, n: int, last: np.ndarray, r: int, horizon: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Forecast paths (draws x horizon x series) of a vector autoregression under a normal-inverse-Wishart prior.

    ``moments`` are the sums of products of (1, lags, targets) over ``n`` rows, ``last`` the newest p rows, newest first.
    """
    m = len(moments) - r
    prec, xt = moments[:m, :m] + 0.1 * np.eye(m), moments[:m, m:]
    mean = np.linalg.solve(prec, xt)
    s = moments[m:, m:] - mean.T @ xt - xt.T @ mean + mean.T @ moments[:m, :m] @ mean
    root, spread = np.linalg.cholesky(np.linalg.inv(prec)), np.linalg.cholesky(np.linalg.inv((s + s.T) / 2 + np.eye(r) * 1e-6))
    out = np.empty((draws, horizon, r))
    for k in range(draws):
        a = np.tril(rng.standard_normal((r, r)), -1) + np.diag(np.sqrt(rng.chisquare(n + r - np.arange(r))))  # Bartlett's factor of a Wishart draw
        c = np.linalg.cholesky(np.linalg.inv(spread @ a @ a.T @ spread.T))
        w = mean + root @ rng.standard_normal(mean.shape) @ c.T
        v = list(last)
        for h in range(horizon):
            out[k, h] = np.concatenate(([1.0], *v)) @ w + c @ rng.standard_normal(r)
            v = [out[k, h], *v[:-1]]
    return out


def bayes_var(df: DataFrame, by: Cols, columns: Cols, p: int = 2, horizon: int = 5, chains: int = 4, draws: int = 100) -> DataFrame:
    """(by, column, step, mean, low, high) of each multivariate series from all its rows.

    The rows only enter sums of products, aggregated by series; chains draw from those side by side. Rows with a NULL are left out first; a series of p rows or fewer gives nothing.
    """
    names, r, keys = list(columns), len(columns), list(by)
    w = Window.partitionBy(*by).orderBy("time")
    rows = df.select(*by, "time", *[F.col(c).cast("double").alias(c) for c in names]).na.drop(subset=names)
    lags = [F.lag(c, i).over(w) for i in range(1, p + 1) for c in names]
    rows = rows.select(*by, "time", F.array(F.lit(1.0), *lags, *names).alias("z")).filter(~F.exists("z", lambda v: v.isNull()))
    size = 1 + r * (p + 1)
    at = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by("z", "time").alias("z"), F.array(*[F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in at]).alias("s"))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                *key, n, z, s, chain = row
                m = np.zeros((size, size))
                for (i, j), v in zip(at, s, strict=True):
                    m[i, j] = m[j, i] = v
                newest = np.concatenate((z[-r:], z[1 : 1 + r * (p - 1)])).reshape(p, r)
                paths = bayes_var_kernel(m, int(n), newest, r, horizon, draws, np.random.default_rng(int(chain)))
                out = [(*key, c, h + 1, float(paths[k, h, j])) for j, c in enumerate(names) for h in range(horizon) for k in range(draws)]
                yield pd.DataFrame(out, columns=[*keys, "column", "step", "value"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    dealt = sums.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).repartition(*by, "chain")
    got = dealt.mapInPandas(run, f"{kinds}column string, step int, value double")
    return got.groupBy(*by, "column", "step").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.05)).alias("low"), F.percentile("value", F.lit(0.95)).alias("high"))


def factor_impute(df: DataFrame, by: Cols, column: str, rank: int = 3, lag: int = 1, rounds: int = 50) -> DataFrame:
    """Temporal matrix factorisation of each panel (series by time): missing values are filled from low-rank factors whose time factor is smoothed by its neighbours; NULLs come back filled as ``imputed``.

    ``by`` names the panel and then the series; a panel is one (bounded) group.
    """
    *panel, sid = by
    if not panel:
        raise ValueError("factor_impute needs a panel column before the series")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=sid, columns="time", values=column, dropna=False)
        y = m.to_numpy(float)
        known = ~np.isnan(y)
        rng = np.random.default_rng(7)
        k = min(rank, *y.shape)
        u, v = rng.standard_normal((y.shape[0], k)) * 0.1, rng.standard_normal((y.shape[1], k)) * 0.1
        base = np.nanmean(y) if known.any() else 0.0
        z = np.where(known, y - base, 0.0)
        for _ in range(rounds):
            for i in range(len(u)):
                a = v[known[i]]
                u[i] = np.linalg.solve(a.T @ a + 0.1 * np.eye(k), a.T @ z[i, known[i]])
            for j in range(len(v)):
                a = u[known[:, j]]
                near = [v[n] for n in (j - lag, j + lag) if 0 <= n < len(v)]
                v[j] = np.linalg.solve(a.T @ a + 0.5 * len(near) * np.eye(k) + 0.01 * np.eye(k), a.T @ z[known[:, j], j] + 0.5 * sum(near))
        full = pd.DataFrame(np.where(known, y, base + u @ v.T), index=m.index, columns=m.columns).stack().rename("imputed").reset_index()
        return pdf.merge(full, on=[sid, "time"], how="left")

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*panel).applyInPandas(run, f"{ddl}, imputed double")

"""Sliding windows, folds, tuning and walk-forward evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.aggregates import metrics
from chronoloom.operators.align import over

Cols = Sequence[str]


def window_bounds(df: DataFrame, by: Cols, window_len: int, horizon: int, limit: int | None = None, purge: int = 0) -> DataFrame:
    """(by, window, train_start, train_end, test_start, test_end) by position from 0, newest window first; train_end is exclusive, test_end inclusive.

    Windows without a whole training part are left out; ``purge`` rows before the test part train nothing.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
    most = F.greatest(F.floor((F.col("n") - (window_len - horizon)) / horizon), F.lit(0)).cast("int")
    most = F.least(most, F.lit(limit)) if limit else most
    w = n.withColumn("window", F.explode(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))))
    end = F.col("n") - 1 - horizon * (F.col("window") - 1)
    start = end - horizon + 1
    return w.select(*by, "window", F.greatest(start - (window_len - horizon), F.lit(0)).alias("train_start"), (start - purge).alias("train_end"), start.alias("test_start"), end.alias("test_end"))


def fold_bounds(df: DataFrame, by: Cols, folds: int) -> DataFrame:
    """Expanding folds of n // (folds + 1) test rows each, with the same columns."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
    size = F.floor(F.col("n") / (folds + 1)).cast("int")
    w = n.withColumns({"window": F.explode(F.sequence(F.lit(1), F.lit(folds))), "_k": size}).filter("_k > 0")
    start = F.col("n") - F.col("_k") * (folds + 1 - F.col("window"))
    return w.select(*by, "window", F.lit(0).alias("train_start"), start.alias("train_end"), start.alias("test_start"), (start + F.col("_k") - 1).alias("test_end"))


#: Rows meet the windows that touch their block of this many positions.
BLOCK = 256


def in_windows(df: DataFrame, bounds: DataFrame, by: Cols) -> DataFrame:
    """Rows of each window with ``part``. Rows and windows are joined by series and block of positions, so a row only meets windows near it."""
    pos = df.withColumn("_i", F.row_number().over(over(by, ["time"])) - 1).withColumn("_block", F.floor(F.col("_i") / BLOCK))
    first, last = F.least("train_start", "test_start"), F.greatest(F.col("train_end") - 1, F.col("test_end"))
    got = pos.join(bounds.withColumn("_block", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))), [*by, "_block"]).drop("_block")
    got = got.filter(((F.col("_i") >= F.col("train_start")) & (F.col("_i") < F.col("train_end"))) | F.col("_i").between(F.col("test_start"), F.col("test_end")))
    return got.withColumn("part", F.when(F.col("_i") >= F.col("test_start"), "test").otherwise("train")).drop("train_start", "train_end", "test_start", "test_end")


def naive_predictions(df: DataFrame, bounds: DataFrame, by: Cols, target: str, season: int = 1) -> DataFrame:
    """The value one season (or its multiple) before each test row, as known when its window's test part starts."""
    rows = df.select(*by, "time", F.col(target).alias("y"), (F.row_number().over(over(by, ["time"])) - 1).alias("_i"))
    test = in_windows(df, bounds, by).filter("part = 'test'").join(bounds.select(*by, "window", "test_start"), [*by, "window"])
    back = (F.floor((F.col("_i") - F.col("test_start")) / season) + 1) * season
    test = test.select(*by, "window", "time", F.col(target).alias("y"), (F.col("_i") - back).alias("_at"), (F.col("_i") - F.col("test_start") + 1).alias("step"))
    past = rows.select(*by, F.col("_i").alias("_at"), F.col("y").alias("predict_value"))
    return test.join(past, [*by, "_at"]).drop("_at")


def scores(predictions: DataFrame, by: Cols, y: str = "y", p: str = "predict_value") -> DataFrame:
    return predictions.groupBy(*by).agg(*[m.alias(n) for n, m in metrics(y, p).items()])


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _spread(x: np.ndarray) -> np.ndarray:
    """The deviation of each column; 1 for a constant one, whose deviation may be rounding of its mean."""
    s = x.std(0)
    return np.where(s > 1e-12 * np.abs(x).max(0, initial=0.0), s, 1.0)


def ridge_kernel(x: np.ndarray, y: np.ndarray, new: np.ndarray, penalty: float = 1e-6) -> np.ndarray:
    m, s = x.mean(0), _spread(x)
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y)
    return np.c_[np.ones(len(new)), (new - m) / s] @ w


def backtest(df: DataFrame, bounds: DataFrame, by: Cols, target: str, features: Cols, kernel: Kernel = ridge_kernel) -> DataFrame:
    """(by, window, time, y, predict_value): fit on each window's training rows and predict its test rows, one group a window.

    The scaler is part of the fit, so nothing of the test part leaks into it.
    """
    rows = in_windows(df.select(*by, "time", target, *features), bounds, by).na.drop(subset=[target, *features])
    cols = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"].sort_values("time")
        p = kernel(train[cols].to_numpy(float), train[target].to_numpy(float), test[cols].to_numpy(float)) if len(train) and len(test) else np.full(len(test), np.nan)
        return test[[*by, "window", "time"]].assign(y=test[target].astype(float), predict_value=p)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*by,))
    time = df.schema["time"].dataType.simpleString()
    return rows.groupBy(*by, "window").applyInPandas(run, f"{kinds + ', ' if by else ''}window int, time {time}, y double, predict_value double")


def draw(grid: dict[str, list], draws: int, seed: int) -> list[dict]:
    """Different points of the grid, at most ``draws``."""
    every = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    return [every[i] for i in np.random.default_rng(seed).permutation(len(every))[:draws]]


def random_search(df: DataFrame, bounds: DataFrame, by: Cols, target: str, features: Cols, grid: dict[str, list], make: Callable[..., Kernel], draws: int = 10, seed: int = 42) -> DataFrame:
    """(trial, params, mae) by increasing mean error over the folds; trials run side by side as groups of one job."""
    picks = draw(grid, draws, seed)
    cols = list(features)
    rows = in_windows(df.select(*by, "time", target, *features), bounds, by).na.drop(subset=[target, *features])
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(picks) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["trial"].iloc[0])
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        mae = float("nan")
        if len(train) and len(test):
            p = make(**picks[k])(train[cols].to_numpy(float), train[target].to_numpy(float), test[cols].to_numpy(float))
            mae = float(np.abs(p - test[target].to_numpy(float)).mean())
        return pd.DataFrame({"trial": [k], "params": [str(picks[k])], "mae": [mae]})

    got = rows.groupBy(*by, "window", "trial").applyInPandas(run, "trial int, params string, mae double")
    return got.groupBy("trial", "params").agg(F.avg("mae").alias("mae")).orderBy("mae", "trial")


def walk_forward(df: DataFrame, by: Cols, target: str, coefficients: Sequence[float]) -> DataFrame:
    """One-step forecasts of an autoregression of known coefficients (intercept first), each from true past values."""
    w = over(by, ["time"])
    e = F.lit(float(coefficients[0]))
    for k, c in enumerate(coefficients[1:], 1):
        e = e + F.lag(target, k).over(w) * float(c)
    return df.withColumn("predict_value", e)


def walk_forward_refit(df: DataFrame, by: Cols, target: str, order: int, start: int) -> DataFrame:
    """The same with the coefficients fitted anew on all rows before each forecast (rank-one updates)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable").reset_index(drop=True)
        y, p = pdf[target].to_numpy(float), np.full(len(pdf), np.nan)
        a, b = 1e-6 * np.eye(order + 1), np.zeros(order + 1)
        for i in range(order, len(y)):
            x = np.r_[1.0, y[i - order : i][::-1]]
            if i >= start:
                p[i] = x @ np.linalg.solve(a, b)
            a, b = a + np.outer(x, x), b + x * y[i]
        return pdf.assign(predict_value=p)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*by).applyInPandas(run, f"{ddl}, predict_value double")


def panel_cv(df: DataFrame, by: Cols, target: str, horizon: int, windows: int, season: int) -> DataFrame:
    """(by, naive, seasonal_naive, historic_mean, best_model): mean absolute errors of cross-validation on each series."""
    from chronoloom.operators.reshape import best_model

    bounds = window_bounds(df, by, horizon + season, horizon, windows)
    rows = df.select(*by, "time", F.col(target).alias("y"), (F.row_number().over(over(by, ["time"])) - 1).alias("_i"))
    sums = rows.withColumns({"_s": F.sum("y").over(over(by, ["_i"]).rowsBetween(Window.unboundedPreceding, -1)), "_n": F.count("y").over(over(by, ["_i"]).rowsBetween(Window.unboundedPreceding, -1))})
    mean = bounds.join(sums, list(by)).filter("_i = test_start").select(*by, "window", F.try_divide("_s", "_n").alias("historic_mean"), "test_start")
    last = bounds.join(rows.select(*by, "_i", F.col("y").alias("naive")), list(by)).filter("_i = test_start - 1").select(*by, "window", "naive")
    seasonal = naive_predictions(df, bounds, by, target, season).withColumnRenamed("predict_value", "seasonal_naive")
    every = seasonal.join(last, [*by, "window"]).join(mean.drop("test_start"), [*by, "window"])
    names = ["naive", "seasonal_naive", "historic_mean"]
    return best_model(every.groupBy(*by).agg(*[F.avg(F.abs(F.col("y") - F.col(n))).alias(n) for n in names]), names)



def _scaled_ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> Callable[[np.ndarray], np.ndarray]:
    """Rows to predictions of all columns of ``y``; the scaler is part of the fit."""
    m, s = x.mean(0), _spread(x)
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y)
    return lambda new: np.r_[1.0, (new - m) / s] @ w


def method_kernel(method: str, y: np.ndarray, x: np.ndarray, new: np.ndarray, steps: Sequence[int], penalty: float = 1e-6) -> np.ndarray:
    """Predictions of the first column of ``y`` for the rows ``new`` (exogenous, of the horizon), by one of the seven strategies.

    ``y``: the endogenous columns of the history, the target first; ``x``: its exogenous columns. The U methods get one
    endogenous column. Direct methods learn every step of the horizon from the lags and exogenous values of its first row; recursive
    ones learn one step and feed predictions back: of all endogenous columns in MSMR, of the target alone in MSMDR,
    where the others stay at their last value. With too few rows to learn from the predictions are NaN.
    """
    h, k, p = len(new), max(steps, default=0), x.shape[1]
    none = np.full(h, np.nan)
    if not h:
        return none
    if method == "USMDO":
        if len(y) <= p + 1:
            return none
        model = _scaled_ridge(x, y[:, :1], penalty)
        return np.array([model(row)[0] for row in new])
    lags = lambda held, t: [held[t - s, c] for c in range(y.shape[1]) for s in steps]
    direct = method in ("USMD", "MSMD")
    last = len(y) - (h - 1 if direct else 0)
    if last - k <= y.shape[1] * len(steps) + p + 1:
        return none
    rows = np.column_stack([y[k - s : last - s, c] for c in range(y.shape[1]) for s in steps] + [x[k:last, j] for j in range(p)])
    if direct:
        model = _scaled_ridge(rows, np.column_stack([y[k + j : last + j, 0] for j in range(h)]), penalty)
        return model(np.r_[lags(y, len(y)), new[0]])
    predicted = range(y.shape[1]) if method == "MSMR" else range(1)
    model = _scaled_ridge(rows, y[k:, predicted], penalty)
    held = np.vstack((y, np.empty((h, y.shape[1]))))
    for t in range(len(y), len(y) + h):
        held[t] = held[t - 1]
        held[t, predicted] = model(np.r_[lags(held, t), new[t - len(y)]])
    return held[len(y) :, 0]


def _kernel_frame(pdf: pd.DataFrame, keys: Cols, method: str, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], penalty: float) -> pd.DataFrame:
    pdf = pdf.sort_values("time", kind="stable")
    train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
    own = [target] if method.startswith("U") else list(dict.fromkeys([target, *endogenous]))
    p = method_kernel(method, train[own].to_numpy(float), train[list(exogenous)].to_numpy(float), test[list(exogenous)].to_numpy(float), steps, penalty)
    return test[[*keys, "time"]].assign(step=np.arange(1, len(test) + 1, dtype=np.int32), y=test[target].astype(float), predict_value=p)


def backtest_method(df: DataFrame, bounds: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], method: str, penalty: float = 1e-6) -> DataFrame:
    """(by, window, time, step, y, predict_value): each window by the strategy ``method`` from its origin, one group a series and window.

    Nothing of the test part is seen but its exogenous columns.
    """
    own = [target] if method.startswith("U") else list(dict.fromkeys([target, *endogenous]))
    cols = list(dict.fromkeys([*own, *exogenous]))
    rows = in_windows(df.select(*by, "time", *cols), bounds, by).na.drop(subset=cols)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    made = lambda pdf: _kernel_frame(pdf, [*by, "window"], method, target, own, exogenous, steps, penalty)
    return rows.groupBy(*by, "window").applyInPandas(made, f"{kinds}, window int, time {df.schema['time'].dataType.simpleString()}, step int, y double, predict_value double")


def forecast_method(history: DataFrame, future: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], method: str, penalty: float = 1e-6) -> DataFrame:
    """(by, time, step, predict_value): the same fit for each series on all its history, for the rows of ``future``; a series is one group."""
    own = [target] if method.startswith("U") else list(dict.fromkeys([target, *endogenous]))
    cols = list(exogenous)
    past = history.select(*by, "time", *own, *cols).na.drop(subset=[*own, *cols]).withColumn("part", F.lit("train"))
    ahead = future.select(*by, "time", *[F.lit(None).cast("double").alias(c) for c in own], *cols).withColumn("part", F.lit("test"))
    kinds = ", ".join(f"`{c}` {history.schema[c].dataType.simpleString()}" for c in by)
    made = lambda pdf: _kernel_frame(pdf, by, method, target, own, exogenous, steps, penalty).drop(columns="y")
    return past.unionByName(ahead).groupBy(*by).applyInPandas(made, f"{kinds}, time {history.schema['time'].dataType.simpleString()}, step int, predict_value double")


def backtest_recursive(df: DataFrame, bounds: DataFrame, by: Cols, target: str, exogenous: Cols, steps: Sequence[int], penalty: float = 1e-6) -> DataFrame:
    """(by, window, time, step, y, predict_value): from one origin a window, test values are never seen; lags come from earlier predictions."""
    from chronoloom.plans.strategies import recursive_kernel

    cols, steps, k = list(exogenous), list(steps), max(steps)
    rows = in_windows(df.select(*by, "time", target, *cols), bounds, by).na.drop(subset=[target, *cols])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        y, x = train[target].to_numpy(float), train[cols].to_numpy(float)
        p = np.full(len(test), np.nan)
        if len(y) > k + len(steps) + len(cols) + 1 and len(test):
            a = np.column_stack([y[k - s : len(y) - s] for s in steps] + [x[k:, j] for j in range(len(cols))])
            m, s = a.mean(0), _spread(a)
            z = np.c_[np.ones(len(a)), (a - m) / s]
            w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y[k:])
            p = np.array(recursive_kernel(lambda v: float(w[0] + w[1:] @ ((v - m) / s)), y, test[cols].to_numpy(float), steps))
        return test[[*by, "window", "time"]].assign(step=np.arange(1, len(test) + 1, dtype=np.int32), y=test[target].astype(float), predict_value=p)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by, "window").applyInPandas(run, f"{kinds}, window int, time {df.schema['time'].dataType.simpleString()}, step int, y double, predict_value double")

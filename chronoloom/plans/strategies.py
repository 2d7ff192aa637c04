"""Seven multi-step forecast strategies over fitted linear models.

The future enters as an array of exogenous rows by step, the history as an array of the
last values; the recursion is an ``aggregate`` over the steps inside one plan, for any
number of series at once.  For models that aren't linear a kernel for each series takes
a predict function.

U/M: one or several endogenous variables; D: direct, one model a step; R: recursive;
DR: recursive by blocks of the least lag; O: exogenous features only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.reshape import last_rows
from chronoloom.operators.windows import lags as add_lags
from chronoloom.operators.windows import targets as add_targets
from chronoloom.plans.learners import LinearModel, Learner, Ridge

Cols = Sequence[str]
METHODS = ("USMDO", "USMD", "USMR", "USMDR", "MSMD", "MSMR", "MSMDR")


def available(future: DataFrame, exogenous: Cols) -> list[str]:
    """Only exogenous columns that the future has."""
    return [c for c in dict.fromkeys(exogenous) if c in future.columns]


def blocks(horizon: int, steps: Sequence[int]) -> tuple[int, int]:
    """Block length (the least lag, or one) and number of blocks."""
    size = min(steps, default=1)
    return size, -(-horizon // size)


def _numbered(future: DataFrame, by: Cols, horizon: int) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy("time"))
    return future.withColumn("step", n).filter(F.col("step") <= horizon)


def usmdo(history: DataFrame, future: DataFrame, by: Cols, target: str, exogenous: Cols, horizon: int, learner: Learner | None = None) -> DataFrame:
    """(by, time, step, predict_value) from exogenous features alone."""
    cols = available(future, exogenous)
    model = (learner or Ridge()).fit(history, cols, [target])
    return model.predict(_numbered(future, by, horizon)).select(*by, "time", "step", F.col(f"{target}_hat").alias("predict_value"))


def direct(history: DataFrame, future: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], horizon: int, learner: Learner | None = None) -> DataFrame:
    """USMD (endogenous = the target) and MSMD: one row, the last history and the first future step, gives all steps."""
    cols = available(future, exogenous)
    wide = add_targets(add_lags(history, by, ["time"], endogenous, steps), by, ["time"], target, horizon)
    features = [f"{c}_lag_{k}" for c in endogenous for k in steps] + cols
    outs = [f"{target}_shift_{h}" for h in range(horizon)]
    model = (learner or Ridge()).fit(wide, features, outs)
    numbered = _numbered(future, by, horizon)
    first = numbered.filter("step = 1").select(*by, *cols)
    past = tail_arrays(history, by, endogenous, max(steps))
    row = past.join(first, list(by)).select(*by, *cols, *[F.element_at(f"_h_{c}", -k).alias(f"{c}_lag_{k}") for c in endogenous for k in steps])
    got = model.predict(row).select(*by, F.posexplode(F.array(*[f"{o}_hat" for o in outs])).alias("_s", "predict_value"))
    return got.join(numbered.select(*by, "time", "step"), [*by]).filter("step = _s + 1").select(*by, "time", "step", "predict_value")


def tail_arrays(history: DataFrame, by: Cols, columns: Cols, n: int) -> DataFrame:
    """(by, _h_{c}): the last n values of each column in order; n is the largest lag, so arrays stay small."""
    tail = last_rows(history, by, ["time"], n)
    rows = F.array_sort(F.collect_list(F.struct("time", *columns)))
    values = lambda c: F.transform("_r", lambda r: r[c].cast("double")).alias(f"_h_{c}")
    return tail.groupBy(*by).agg(rows.alias("_r")).select(*by, *map(values, columns))


def recursive(history: DataFrame, future: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], horizon: int, predict: Cols | None = None, penalty: float = 0.0) -> DataFrame:
    """USMR, USMDR (endogenous = the target), MSMR (all endogenous predicted) and MSMDR (``predict`` = the target, others stay at their last value).

    A block recursion updates the history at every step, so blocks change nothing but the bookkeeping.
    """
    cols = available(future, exogenous)
    predict = list(predict if predict is not None else endogenous)
    wide = add_lags(history, by, ["time"], endogenous, steps)
    features = [f"{c}_lag_{k}" for c in endogenous for k in steps] + cols
    model = Ridge(penalty).fit(wide, features, predict)
    return roll(tail_arrays(history, by, endogenous, max(steps)), _numbered(future, by, horizon), model, by, target, endogenous, cols, steps)


def roll(past: DataFrame, numbered: DataFrame, model: LinearModel, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int]) -> DataFrame:
    """The recursion kernel: state is one array for each endogenous column, each step appends and trims."""
    rows = F.array_sort(F.collect_list(F.struct("step", "time", *exogenous)))
    fut = numbered.groupBy(*by).agg(rows.alias("_f"))
    joined = past.join(fut, list(by))
    keep = max(steps)
    w = {t: model.weights[:, j] for j, t in enumerate(model.targets)}

    def value(state: Column, row: Column, c: str) -> Column:
        if c not in w:
            return F.element_at(state[f"_h_{c}"], -1)
        e, i = F.lit(float(w[c][0])), 1
        for d in endogenous:
            for k in steps:
                e, i = e + F.element_at(state[f"_h_{d}"], -k) * float(w[c][i]), i + 1
        for x in exogenous:
            e, i = e + row[x].cast("double") * float(w[c][i]), i + 1
        return e

    def step(state: Column, row: Column) -> Column:
        new = {c: value(state, row, c) for c in endogenous}
        held = [F.slice(F.concat(state[f"_h_{c}"], F.array(new[c])), F.greatest(F.size(state[f"_h_{c}"]) + 2 - keep, F.lit(1)), keep).alias(f"_h_{c}") for c in endogenous]
        return F.struct(*held, F.concat(state["out"], F.array(new[target])).alias("out"))

    start = F.struct(*[F.col(f"_h_{c}") for c in endogenous], F.array().cast("array<double>").alias("out"))
    out = F.aggregate("_f", start, step, lambda s: s["out"])
    got = joined.withColumn("_out", out).select(*by, F.explode(F.arrays_zip("_f", F.col("_out").alias("p"))).alias("z"))
    return got.select(*by, F.col("z._f.time").alias("time"), F.col("z._f.step").alias("step"), F.col("z.p").alias("predict_value"))


def forecast(method: str, history: DataFrame, future: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, steps: Sequence[int], horizon: int) -> DataFrame:
    """Dispatch by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    if method == "USMDO":
        return usmdo(history, future, by, target, exogenous, horizon)
    own = [target] if method.startswith("U") else list(dict.fromkeys([target, *endogenous]))
    if method in ("USMD", "MSMD"):
        return direct(history, future, by, target, own, exogenous, steps, horizon)
    return recursive(history, future, by, target, own, exogenous, steps, horizon, [target] if method == "MSMDR" else None)


def recursive_kernel(predict: Callable[[np.ndarray], float], past: Sequence[float], exogenous: np.ndarray, steps: Sequence[int], fill: float | None = None) -> list[float]:
    """The same recursion for any one-row model; a lag before the start is ``fill``, or an error without one."""
    values, n, out = list(past), len(past), []
    for h in range(len(exogenous)):
        row = []
        for k in steps:
            at = n + h - k
            if at < 0 and fill is None:
                raise ValueError(f"lag {k} reaches before the history at step {h + 1}")
            row.append(values[at] if at >= 0 else fill)
        out.append(float(predict(np.concatenate((row, exogenous[h])))))
        values.append(out[-1])
    return out


def rolled_vector(predict: Callable[[np.ndarray], float], last: Sequence[float], horizon: int) -> list[float]:
    """Feature vector shifted by one each step, the newest prediction in the last place."""
    x, out = np.array(last, float), []
    for _ in range(horizon):
        out.append(float(predict(x)))
        x = np.roll(x, -1)
        x[-1] = out[-1]
    return out


def windowed_forecast(df: DataFrame, by: Cols, target: str, fit: Callable, mode: str, size: int, ahead: int) -> DataFrame:
    """Sequence prediction for each series: ``point`` (true values at every step), ``multiple`` (restart every ``ahead`` rows) or ``full``."""
    if mode not in ("point", "multiple", "full"):
        raise ValueError(f"unknown mode: {mode}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable").reset_index(drop=True)
        y = pdf[target].to_numpy(float)
        predict = fit(y, size)
        out, x = np.full(len(y), np.nan), None
        for i in range(size, len(y)):
            if x is None or mode == "point" or (mode == "multiple" and (i - size) % ahead == 0):
                x = y[i - size : i].copy()
            out[i] = predict(x)
            x = np.append(x[1:], out[i])
        return pdf.assign(predict_value=out)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*by).applyInPandas(run, f"{ddl}, predict_value double")


def ar_fit(y: np.ndarray, size: int) -> Callable[[np.ndarray], float]:
    """Least squares on the last ``size`` values."""
    x = np.array([[1.0, *y[i - size : i]] for i in range(size, len(y))])
    w = np.linalg.lstsq(x, y[size:], rcond=None)[0] if len(x) else np.zeros(size + 1)
    return lambda v: float(w[0] + w[1:] @ v)


def interval(forecasts: DataFrame, scores: DataFrame, error: str = "mae", z: float = 1.96) -> DataFrame:
    """``low`` and ``high``: z times the root of the folds' deviation of the error; the scores are one row a fold."""
    s = scores.agg(F.sqrt(F.stddev_pop(error)).alias("_s"))
    return forecasts.crossJoin(F.broadcast(s)).select(*forecasts.columns, (F.col("predict_value") - z * F.col("_s")).alias("low"), (F.col("predict_value") + z * F.col("_s")).alias("high"))  # one row

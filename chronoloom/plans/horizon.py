"""Direct forecasts of long horizons: one linear model for all steps, whose plan doesn't depend on their number.

A series' rows stream by in time order; a task keeps only the rows that a lag or a step reaches back over, and adds
products of features and the next ``horizon`` values into one matrix a series. Those matrices, of the size of
features times horizon, are all that is gathered; a series' forecast is one row of features times its weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.align import over
from chronoloom.plans.strategies import available, tail_arrays

Cols = Sequence[str]
#: Rows whose next values stand side by side at once.
ROWS = 4096


def reuse_last(history: DataFrame, by: Cols, columns: Cols, n: int, step: str) -> DataFrame:
    """(by, time, columns): the last ``n`` rows of each series again, ``n`` steps later, as a stand-in for what isn't known ahead."""
    from chronoloom.operators.reshape import last_rows

    return last_rows(history.select(*by, "time", *columns), by, ["time"], n).withColumn("time", F.col("time") + F.expr(f"{n} * INTERVAL {step}"))


def _products(y: np.ndarray, x: np.ndarray, lags: Sequence[int], horizon: int, start: int) -> tuple[np.ndarray, int]:
    """Sums of products of (1, lags, exogenous) with themselves and the next ``horizon`` targets, for the rows from ``start`` on that have all of these; and the first row not done."""
    k, p = max(lags, default=0), y.shape[1]
    first, end = max(start, k), len(y) - horizon + 1
    width = 1 + p * len(lags) + x.shape[1]
    total = np.zeros((width, width + horizon))
    for at in range(first, end, ROWS):
        t = np.arange(at, min(at + ROWS, end))
        rows = np.column_stack([np.ones(len(t)), *[y[t - s, c] for c in range(p) for s in lags], x[t]])
        ahead = np.lib.stride_tricks.sliding_window_view(y[:, 0], horizon)[t]
        whole = ~(np.isnan(rows).any(1) | np.isnan(ahead).any(1))
        total += rows[whole].T @ np.hstack((rows, ahead))[whole]
    return total, max(first, end)


def long_sums(history: DataFrame, by: Cols, endogenous: Cols, exogenous: Cols, lags: Sequence[int], horizon: int) -> DataFrame:
    """(by, sums binary): one matrix for each series."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    cols = [*[number(c).alias(f"y{i}") for i, c in enumerate(endogenous)], *[number(c).alias(f"x{i}") for i, c in enumerate(exogenous)]]
    rows = history.select(*by, "time", *cols).repartition(*by).sortWithinPartitions(*by, "time").drop("time")
    keys, p = len(by), len(endogenous)
    back = max(lags, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, done, total = np.zeros((0, p + len(exogenous))), None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key, pa.array([total.tobytes()], pa.binary())], [*by, "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            values = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[keys:]])
            said = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
            starts = [0, *[i for i in range(1, len(said)) if said[i] != said[i - 1]]]
            for s, e in zip(starts, [*starts[1:], len(said)], strict=True):
                new = [b.column(i).slice(s, 1) for i in range(keys)]
                if key is None or [c.to_pylist() for c in key] != [c.to_pylist() for c in new]:
                    if key is not None:
                        yield out()
                    held, key, done, total = values[:0], new, 0, None
                held = np.vstack((held, values[s:e]))
                part, done = _products(held[:, :p], held[:, p:], lags, horizon, done)
                total = part if total is None else total + part
                gone = max(0, done - back)
                held, done = held[gone:], done - gone
        if key is not None:
            yield out()

    kinds = ", ".join(f"`{c}` {history.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(run, f"{kinds}, sums binary")


def direct_long(history: DataFrame, future: DataFrame, by: Cols, target: str, endogenous: Cols, exogenous: Cols, lags: Sequence[int], horizon: int, penalty: float = 0.0) -> DataFrame:
    """(by, time, step, predict_value): all steps from the last values of each series and the first row of ``future``, one fit a series.

    ``penalty`` is ridge's, on all but the intercept. Rows that miss a value among their lags or steps train nothing; a series with fewer rows to
    learn from than weights, or with a gap in its last lags, gives nothing.
    """
    cols, own = available(future, exogenous), list(dict.fromkeys([target, *endogenous]))
    sums = long_sums(history, by, own, cols, lags, horizon)
    numbered = future.withColumn("step", F.row_number().over(over(by, ["time"]))).filter(F.col("step") <= horizon)
    first = numbered.filter("step = 1").select(*by, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).cast("array<double>").alias("_x"))
    past = tail_arrays(history, by, own, max(lags))
    start = past.select(*by, F.array(*[F.try_element_at(F.col(f"_h_{c}"), F.lit(-k)) for c in own for k in lags]).alias("_l"))
    rows = sums.join(start, list(by)).join(first, list(by))
    width = 1 + len(own) * len(lags) + len(cols)
    kept = [*by, "step", "predict_value"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                total = np.frombuffer(r.sums).reshape(width, width + horizon)
                x = np.array([1.0, *r.l, *r.x], float)
                if total[0, 0] < width or np.isnan(x).any():
                    continue
                a = total[:, :width] + penalty * np.diag([0.0] + [1.0] * (width - 1))
                size = np.sqrt(np.diag(a))
                size = np.where(size > 0, size, 1.0)[:, None]
                w = np.linalg.lstsq(a / size / size.T, total[:, width:] / size, rcond=None)[0] / size
                key = tuple(r)[: len(by)]
                out.append(pd.DataFrame({**{c: [v] * horizon for c, v in zip(by, key, strict=True)}, "step": np.arange(1, horizon + 1, dtype=np.int32), "predict_value": x @ w}))
            yield pd.concat(out) if out else pd.DataFrame(columns=kept)

    kinds = ", ".join(f"`{c}` {history.schema[c].dataType.simpleString()}" for c in by)
    got = rows.select(*by, "sums", F.col("_l").alias("l"), F.col("_x").alias("x")).mapInPandas(run, f"{kinds}, step int, predict_value double")
    return numbered.select(*by, "time", "step").join(got, [*by, "step"]).select(*by, "time", "step", "predict_value")

"""Vector autoregression on log differences: every order from nested blocks of one matrix of sums, the order by criterion.

Rows enter only through sums of products, which each task adds up series by series; a series' matrix, its
size set by columns and orders, is all that is gathered, with the last rows that a forecast starts from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.align import over
from chronoloom.operators.reshape import last_rows

Cols = Sequence[str]


def log_differences(df: DataFrame, by: Cols, columns: Cols) -> DataFrame:
    """``{c}_dlog``: the difference of logarithms to the row before; null where one of the two values isn't positive."""
    w = over(by, ["time"])
    log = lambda c: F.when(F.col(f"`{c}`") > 0, F.ln(F.col(f"`{c}`")))
    return df.withColumns({f"{c}_dlog": log(c) - F.lag(log(c), 1).over(w) for c in columns})


def sums_by_series(df: DataFrame, by: Cols, columns: Cols) -> DataFrame:
    """(by, cell, v): the sums of products of (1, columns) of each series over its complete rows, upper triangle by rows.

    A task holds one matrix at a time as long as the rows of a series follow each other, as they do behind a window.
    """
    names = [f"c{i}" for i in range(len(columns))]
    full = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).na.drop(subset=names)
    q = len(columns) + 1
    upper = np.triu_indices(q)
    keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def out() -> pa.RecordBatch:
            cells = total[upper]
            each = pa.array(np.zeros(len(cells), np.int64))
            return pa.RecordBatch.from_arrays([*(k.take(each) for k in held), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], [*by, "cell", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns[keys:]]])
            said = pd.DataFrame({i: b.column(i).to_pandas() for i in range(keys)}).astype(object)
            new = (said != said.shift()).where(~(said.isna() & said.shift().isna()), False).any(axis=1).to_numpy(bool)
            new[0] = True
            starts = np.flatnonzero(new)
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = [b.column(i).slice(s, 1) for i in range(keys)]
                if held is None or any(k.to_pylist() != h.to_pylist() for k, h in zip(key, held, strict=True)):
                    if held is not None:
                        yield out()
                    held, total = key, np.zeros((q, q))
                total += x[s:e].T @ x[s:e]
        if held is not None:
            yield out()

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return full.mapInArrow(run, f"{kinds}, cell int, v double").groupBy(*by, "cell").agg(F.sum("v").alias("v"))


def nested_orders(moments: np.ndarray, k: int, most: int) -> list[tuple[float, np.ndarray]]:
    """(criterion, weights) of the orders 1 to ``most`` on one sample; ``moments``: of (1, k values a lag for each lag, k targets).

    The criterion is ln det of the residuals' covariance (divisor n) plus 2 / n for each weight, infinite where the sample is too small or singular.
    """
    n, t = moments[0, 0], 1 + k * most
    out = []
    for p in range(1, most + 1):
        m = 1 + k * p
        a, b = moments[:m, :m], moments[:m, t:]
        if n <= m:
            out.append((np.inf, np.zeros((m, k))))
            continue
        size = np.sqrt(np.diag(a))
        size = np.where(size > 0, size, 1.0)[:, None]
        w = np.linalg.lstsq(a / size / size.T, b / size, rcond=None)[0] / size
        left = moments[t:, t:] - w.T @ b - b.T @ w + w.T @ a @ w
        sign, logdet = np.linalg.slogdet((left + left.T) / 2 / n)
        out.append((float(logdet + 2 * m * k / n) if sign > 0 else np.inf, w))
    return out


def var_log(df: DataFrame, by: Cols, columns: Cols, most: int = 4, steps: int = 5) -> DataFrame:
    """(by, order, aic, step, columns): forecasts of the levels from each series' last row, by the order up to ``most`` of least criterion (of several, the lowest).

    Rows with a value that isn't positive, or next to one, train nothing. A series too short for any order, or whose last
    ``most`` + 1 rows are incomplete, gives nothing.
    """
    diff = [f"{c}_dlog" for c in columns]
    wide = log_differences(df.select(*by, "time", *columns), by, columns)
    w, k = over(by, ["time"]), len(columns)
    lagged = wide.select("*", *[F.lag(c, s).over(w).alias(f"{c}_{s}") for s in range(1, most + 1) for c in diff])
    cells = sums_by_series(lagged, by, [*[f"{c}_{s}" for s in range(1, most + 1) for c in diff], *diff])
    tail = last_rows(wide, by, ["time"], most)
    # Both as rows of one table: (kind, at, values).
    matrix = cells.select(*by, F.lit(0).alias("kind"), F.col("cell").cast("double").alias("at"), F.array("v").alias("x"))
    ends = tail.select(*by, F.lit(1).alias("kind"), F.row_number().over(w).cast("double").alias("at"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns], *diff).alias("x"))
    q = 1 + k * (most + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[*by, "order", "aic", "step", *columns])
        cell, end = (pdf[pdf["kind"] == i].sort_values("at") for i in (0, 1))
        if len(cell) != q * (q + 1) // 2 or len(end) < most:
            return empty
        rows = np.array([[np.nan if v is None else v for v in x] for x in end["x"]], float)
        if np.isnan(rows).any():
            return empty
        moments = np.zeros((q, q))
        moments[np.triu_indices(q)] = [x[0] for x in cell["x"]]
        moments += np.triu(moments, 1).T
        found = nested_orders(moments, k, most)
        p = min(range(most), key=lambda i: (found[i][0], i))
        if not np.isfinite(found[p][0]):
            return empty
        past, level, out = list(rows[::-1, k:]), rows[-1, :k], []
        for _ in range(steps):
            past.insert(0, np.r_[1.0, np.concatenate(past[: p + 1])] @ found[p][1])
            level = level * np.exp(past[0])
            out.append(level)
        ahead = pd.DataFrame(out, columns=list(columns))
        return pd.concat([pd.DataFrame({**{c: [pdf[c].iloc[0]] * steps for c in by}, "order": p + 1, "aic": found[p][0], "step": np.arange(1, steps + 1)}), ahead], axis=1)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return matrix.unionByName(ends).groupBy(*by).applyInPandas(run, f"{kinds}, order int, aic double, step int, {', '.join(f'`{c}` double' for c in columns)}")

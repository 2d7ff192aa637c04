"""Grids of exponential smoothing: all parameters of a grid in one pass over each series, scored on its last rows.

Rows stream by in time order, so a task holds one state for each point of the grid, never a series; the last ``holdout`` rows
of a series are forecast from the state before them, and the point of least mean absolute error there is the series' best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.align import over

Cols = Sequence[str]


class Grid:
    """The states of additive smoothing for all points (alpha, beta[, gamma]); ``season`` 0 has none.

    The first value and the first difference start the level and trend; with a season, the first two seasons' means do, and the first
    season's distances from its mean start the seasonal terms.
    """

    def __init__(self, points: np.ndarray, season: int):
        self.points, self.season, self.first = points, season, []
        self.level = None

    @property
    def needs(self) -> int:
        return 2 * self.season if self.season else 2

    def _start(self) -> None:
        y, m, k = np.array(self.first), self.season, len(self.points)
        base = y[:m].mean() if m else y[0]
        self.level, self.trend = np.full(k, base), np.full(k, (y[m:].mean() - base) / m if m else y[1] - y[0])
        self.terms, self.at = np.tile(y[:m] - base, (k, 1)), 0
        for v in y[m:] if m else y[1:]:
            self._step(v)

    def _step(self, y: float) -> None:
        alpha, beta = self.points[:, 0], self.points[:, 1]
        term = self.terms[:, self.at] if self.season else 0.0
        level = alpha * (y - term) + (1 - alpha) * (self.level + self.trend)
        self.trend = beta * (level - self.level) + (1 - beta) * self.trend
        self.level = level
        if self.season:
            self.terms[:, self.at] = self.points[:, 2] * (y - level) + (1 - self.points[:, 2]) * term
            self.at = (self.at + 1) % self.season

    def add(self, y: float) -> None:
        if self.level is not None:
            self._step(y)
        else:
            self.first.append(y)
            if len(self.first) == self.needs:
                self._start()

    def ahead(self, h: int) -> np.ndarray:
        """Forecasts of the h-th next value, from 1."""
        term = self.terms[:, (self.at + h - 1) % self.season] if self.season else 0.0
        return self.level + h * self.trend + term


def grid_search(df: DataFrame, by: Cols, column: str, alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float] | None = None, season: int = 0, holdout: int = 48) -> DataFrame:
    """(by, alpha, beta[, gamma], mae): each series' best point; of equal ones the first by alpha, then beta, then gamma.

    Rows without a value are left out. A series needs ``holdout`` rows and as many before them as its start takes, else it gives nothing.
    """
    if (gammas is None) != (not season):
        raise ValueError("gammas and a season go together")
    points = np.array(list(product(alphas, betas, *([gammas] if season else []))), float)
    names = ["alpha", "beta", *(["gamma"] if season else [])]
    w = over(by, ["time"])
    rows = df.select(*by, "time", F.col(f"`{column}`").cast("double").alias("_y")).filter(F.col("_y").isNotNull() & ~F.isnan("_y"))
    left = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w)  # rows after this one
    rows = rows.withColumn("_left", left).sortWithinPartitions(*by, "time").select(*by, "_y", "_left")
    keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, errors, key, old = None, None, None, None
        for b in batches:
            said = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
            for k, (y, rest) in enumerate(zip(b.column(keys).to_pylist(), b.column(keys + 1).to_pylist(), strict=True)):
                if said[k] != old or grid is None:
                    grid, errors, old = Grid(points, season), np.zeros(len(points)), said[k]
                    key = [b.column(i).slice(k, 1) for i in range(keys)]
                if rest >= holdout:
                    grid.add(y)
                elif grid.level is not None:
                    errors += np.abs(y - grid.ahead(holdout - rest))
                if not rest:
                    if grid.level is not None:
                        at = int(np.argmin(np.round(errors / holdout, 12)))
                        yield pa.RecordBatch.from_arrays([*key, *(pa.array([float(v)]) for v in points[at]), pa.array([float(errors[at] / holdout)])], [*by, *names, "mae"])
                    grid = None

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}, mae double")

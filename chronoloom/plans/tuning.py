"""Search over several parameters of boosted trees: successive halving and a Parzen estimator, trials as groups of one job.

A rung (or batch) is one job: rows meet the folds of their series, each fold meets the trials still in the
race, and every (series, fold, trial) is a group that fits and scores on its own. The driver receives a row a trial.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.plans.backtest import in_windows
from chronoloom.plans.trees import Boosting, boost_arrays

Cols = Sequence[str]
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, r: np.random.Generator):
        return self.values[int(r.integers(len(self.values)))]


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``, evenly or by their logarithms, whole ones if so asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, r: np.random.Generator):
        return self.at(float(r.random()))

    def at(self, u: float):
        v = self.low * (self.high / self.low) ** u if self.log else self.low + (self.high - self.low) * u
        return int(round(v)) if self.whole else float(v)

    def place(self, v: float) -> float:
        """Where in 0 to 1 a value lies."""
        if self.high == self.low:
            return 0.0
        return float(np.log(v / self.low) / np.log(self.high / self.low) if self.log else (v - self.low) / (self.high - self.low))


Space = dict[str, Choice | Span]

#: The random search's grid of six parameters, and the spans of the Bayesian one.
GRID: Space = {"leaves": Choice((15, 31, 63)), "rate": Choice((0.01, 0.05, 0.1)), "feature_share": Choice((0.7, 0.8, 0.9)), "l1": Choice((0.1, 0.5, 1.0)), "l2": Choice((0.1, 0.5, 1.0)), "rows": Choice((20, 50, 100))}
SPANS: Space = {"rate": Span(0.01, 0.3), "leaves": Span(20, 100, whole=True), "depth": Span(3, 12, whole=True)}


def boosted(rounds: int, **params) -> Kernel:
    learner = Boosting(rounds=rounds, **params)
    return lambda x, y, new: boost_arrays(x, y[:, None], new, learner)[:, 0]


def score_trials(df: DataFrame, bounds: DataFrame, by: Cols, target: str, features: Cols, trials: dict[int, dict], rounds: int, make: Callable[..., Kernel] = boosted) -> dict[int, float]:
    """The mean absolute error of each trial over all folds of all series, each fold with equal weight; infinite without any."""
    cols = list(features)
    rows = in_windows(df.select(*by, "time", target, *cols), bounds, by).na.drop(subset=[target, *cols])
    rows = rows.withColumn("trial", F.explode(F.array(*[F.lit(k) for k in sorted(trials)])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["trial"].iloc[0])
        pdf = pdf.sort_values("time", kind="stable")
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        if not len(train) or not len(test):
            return pd.DataFrame({"trial": [], "mae": []})
        p = make(rounds=rounds, **trials[k])(train[cols].to_numpy(float), train[target].to_numpy(float), test[cols].to_numpy(float))
        return pd.DataFrame({"trial": [k], "mae": [float(np.abs(p - test[target].to_numpy(float)).mean())]})

    got = rows.groupBy(*by, "window", "trial").applyInPandas(run, "trial int, mae double").groupBy("trial").agg(F.avg("mae").alias("mae")).collect()  # a row a trial
    return {k: np.inf for k in trials} | {r["trial"]: r["mae"] for r in got}


def halving_search(df: DataFrame, bounds: DataFrame, by: Cols, target: str, features: Cols, space: Space = GRID, trials: int = 27, rungs: Sequence[int] = (5, 15, 45), keep: float = 1 / 3, seed: int = 42, make: Callable[..., Kernel] = boosted) -> DataFrame:
    """(trial, params, rung, rounds, mae, best) of each trial at the last rung it reached: after every rung the best ``keep`` of its trials, one at least, go on.

    Equal errors go to the lower trial.
    """
    if not trials or not rungs:
        raise ValueError("a search needs trials and rungs")
    r = np.random.default_rng(seed)
    drawn = {k: {n: s.draw(r) for n, s in space.items()} for k in range(trials)}
    left, out = dict(drawn), {}
    for rung, rounds in enumerate(rungs):
        mae = score_trials(df, bounds, by, target, features, left, rounds, make)
        order = sorted(left, key=lambda k: (mae[k], k))
        out |= {k: (rung, rounds, mae[k]) for k in left}
        if rung + 1 < len(rungs):
            left = {k: left[k] for k in order[: max(1, round(len(left) * keep))]}
    return _table(df, drawn, out, order[0])


def parzen_search(df: DataFrame, bounds: DataFrame, by: Cols, target: str, features: Cols, space: Space = SPANS, trials: int = 24, batch: int = 6, rounds: int = 20, good: float = 0.25, candidates: int = 64, seed: int = 42, make: Callable[..., Kernel] = boosted) -> DataFrame:
    """The same columns (``rung``: the batch) for a search that learns: each batch after the first is drawn where the density of the best ``good`` trials is
    largest against that of the others (kernels for spans); choices are drawn in proportion to it."""
    if not trials or not batch:
        raise ValueError("a search needs trials")
    r = np.random.default_rng(seed)
    drawn: dict[int, dict] = {}
    out: dict[int, tuple] = {}
    for at in range(0, trials, batch):
        new = range(at, min(at + batch, trials))
        known = sorted((k for k in out if np.isfinite(out[k][2])), key=lambda k: (out[k][2], k))
        n = max(1, round(len(known) * good))
        fine, rest = [drawn[k] for k in known[:n]], [drawn[k] for k in known[n:]]
        picked = {k: {name: s.draw(r) for name, s in space.items()} if not rest else {name: _proposed(s, [p[name] for p in fine], [p[name] for p in rest], candidates, r) for name, s in space.items()} for k in new}
        drawn |= picked
        mae = score_trials(df, bounds, by, target, features, picked, rounds, make)
        out |= {k: (at // batch, rounds, mae[k]) for k in new}
    return _table(df, drawn, out, min(out, key=lambda k: (out[k][2], k)))


def _proposed(s: Choice | Span, fine: list, rest: list, candidates: int, r: np.random.Generator):
    if isinstance(s, Choice):
        share = lambda own: np.array([1 + own.count(v) for v in s.values]) / (len(s.values) + len(own))
        p = share(fine) ** 2 / share(rest)
        return s.values[int(r.choice(len(s.values), p=p / p.sum()))]
    a, b = (np.array([s.place(v) for v in own]) for own in (fine, rest))
    width = max(0.05, 1 / (1 + len(fine)))
    density = lambda at, u: np.append(np.exp(-0.5 * ((u[:, None] - at) / width) ** 2), np.full((len(u), 1), 0.1), axis=1).mean(1)
    u = np.clip(a[r.integers(len(a), size=candidates)] + width * r.standard_normal(candidates), 0, 1)
    return s.at(float(u[int(np.argmax(density(a, u) / density(b, u)))]))


def _table(df: DataFrame, drawn: dict[int, dict], out: dict[int, tuple], best: int) -> DataFrame:
    rows = [(k, json.dumps(drawn[k], sort_keys=True), *out[k], k == best) for k in sorted(drawn)]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, rung int, rounds int, mae double, best boolean")

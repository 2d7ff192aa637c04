"""Ensembles: averages, weights by least squares on the simplex, stacking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.align import hashed_share
from chronoloom.plans.learners import Learner, Model, Ridge, gram

Cols = Sequence[str]


def average(df: DataFrame, predictions: Cols, name: str = "ensemble") -> DataFrame:
    """Averaging; voting and blending of predictions are the same."""
    return weighted(df, predictions, [1.0] * len(predictions), name)


def weighted(df: DataFrame, predictions: Cols, weights: Sequence[float], name: str = "ensemble") -> DataFrame:
    total = sum(weights)
    return df.withColumn(name, sum((F.col(p) * float(w) for p, w in zip(predictions, weights, strict=True)), F.lit(0.0)) / total)


def simplex_weights(df: DataFrame, predictions: Cols, y: str, steps: int = 5000) -> list[float]:
    """Weights, none negative and one in sum, of the least squared error: the Gram matrix is one aggregate, the rest is a small projected descent."""
    a, b = gram(df, predictions, [y])
    a, b = a[1:, 1:], b[1:, 0]
    w = np.full(len(b), 1 / len(b))
    rate = 1 / max(np.linalg.eigvalsh(a).max(), 1e-12)
    for _ in range(steps):
        v = w - rate * (a @ w - b)
        u = np.sort(v)[::-1]
        k = np.flatnonzero(u * np.arange(1, len(u) + 1) > np.cumsum(u) - 1)[-1]
        w = np.maximum(v - (u[: k + 1].sum() - 1) / (k + 1), 0)
    return [float(x) for x in w]


def stack(validation: DataFrame, predictions: Cols, y: str, meta: Learner | None = None) -> Model:
    """A second learner on the first ones' predictions for rows they weren't fitted on."""
    return (meta or Ridge(1e-6)).fit(validation, predictions, [y])


def out_of_fold(train: DataFrame, test: DataFrame, features: Cols, y: str, learners: dict[str, Learner], key: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """``{name}_oof`` for training rows from models of the other folds; for test rows the folds' mean."""
    part = F.floor(hashed_share([key]) * folds)
    out = None
    for k in range(folds):
        own, rest = train.filter(part == k), train.filter(part != k)
        for name, learner in learners.items():
            model = learner.fit(rest, features, [y])
            own = model.predict(own).withColumnRenamed(f"{y}_hat", f"{name}_oof")
            test = model.predict(test).withColumnRenamed(f"{y}_hat", f"_{name}_{k}")
        out = own if out is None else out.unionByName(own)
    test = test.withColumns({f"{n}_oof": sum((F.col(f"_{n}_{k}") for k in range(folds)), F.lit(0.0)) / folds for n in learners})
    return out, test.drop(*[f"_{n}_{k}" for n in learners for k in range(folds)])

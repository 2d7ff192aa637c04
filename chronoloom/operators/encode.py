"""Scaling, category codes and feature groups; fitting and applying are apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.joins import lookup

Cols = Sequence[str]


def fit_scaler(df: DataFrame, columns: Cols, kind: str = "standard") -> DataFrame:
    """One row of parameters: ``{c}_shift`` and ``{c}_scale`` (population deviation, or range); a constant column scales by one."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler: {kind}")
    out = []
    for c in columns:
        size = F.stddev_pop(c) if kind == "standard" else F.max(c) - F.min(c)
        out += [(F.avg(c) if kind == "standard" else F.min(c)).alias(f"{c}_shift"), F.when(size > 0, size).otherwise(1.0).alias(f"{c}_scale")]
    return df.agg(*out)


def scale(df: DataFrame, params: DataFrame, columns: Cols) -> DataFrame:
    wide = df.crossJoin(F.broadcast(params))  # one row
    return wide.withColumns({c: (F.col(c) - F.col(f"{c}_shift")) / F.col(f"{c}_scale") for c in columns}).drop(*[f"{c}_{p}" for c in columns for p in ("shift", "scale")])


def unscale(df: DataFrame, params: DataFrame, column: str, source: str) -> DataFrame:
    """A prediction ``column`` back on the scale of the target ``source``."""
    wide = df.crossJoin(F.broadcast(params.select(f"{source}_shift", f"{source}_scale")))  # one row
    return wide.withColumn(column, F.col(column) * F.col(f"{source}_scale") + F.col(f"{source}_shift")).drop(f"{source}_shift", f"{source}_scale")


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): positions of the sorted distinct values from 0."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def encode(df: DataFrame, codes: DataFrame, column: str, unknown: int = 0, missing: int = -1) -> DataFrame:
    """``{c}_code``; a value that was not fitted is ``unknown``, NULL is ``missing``."""
    got = lookup(df, codes, [column])
    return got.withColumn(f"{column}_code", F.when(F.col(column).isNull(), missing).otherwise(F.coalesce("code", F.lit(unknown)))).drop("code")


def feature_groups(columns: Cols, categorical: Cols = ()) -> dict[str, list[str]]:
    """Disjoint groups by name: lag before weather before datetime before categorical before other."""
    groups: dict[str, list[str]] = {"lag": [], "weather": [], "datetime": [], "categorical": [], "other": []}
    for c in dict.fromkeys(columns):
        if "_lag_" in c:
            groups["lag"].append(c)
        elif c.startswith(("rt_", "pred_", "cal_")):
            groups["weather"].append(c)
        elif c.startswith(("dt_", "datetime_", "date_type")):
            groups["datetime"].append(c)
        elif c in categorical:
            groups["categorical"].append(c)
        else:
            groups["other"].append(c)
    return groups


def box_cox_lambda(values: Sequence[float]) -> float:
    """The exponent of the largest profile likelihood on a grid of -2 .. 2, for a bounded sample of positive values."""
    y = np.asarray(values, float)
    logs = np.log(y)

    def likelihood(lam: float) -> float:
        z = logs if abs(lam) < 1e-12 else (y**lam - 1) / lam
        return -0.5 * len(y) * np.log(z.var()) + (lam - 1) * logs.sum()

    return float(max(np.linspace(-2, 2, 401), key=likelihood))


def box_cox(df: DataFrame, column: str, lam: float, name: str | None = None) -> DataFrame:
    x = F.ln(column) if lam == 0 else (F.pow(column, F.lit(lam)) - 1) / lam
    return df.withColumn(name or column, x)

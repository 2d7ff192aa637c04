"""Sorts, top-k, set operations and reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def top(df: DataFrame, column: str, n: int, tie: Cols = ()) -> DataFrame:
    return df.orderBy(F.desc(column), *tie).limit(n)


def last_rows(df: DataFrame, by: Cols, order: Cols, n: int) -> DataFrame:
    """The last n rows of each series."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def best_model(df: DataFrame, models: Cols, name: str = "best_model") -> DataFrame:
    """The column of the least value in each row, the earlier name on ties."""
    least = F.array_min(F.array(*[F.struct(F.col(m).alias("v"), F.lit(m).alias("m")) for m in models]))
    return df.withColumn(name, least["m"])


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def unpivot(df: DataFrame, keys: Cols, columns: Cols, name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def pivot(df: DataFrame, keys: Cols, name: str, value: str, values: Cols) -> DataFrame:
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.first(value))


def vector(df: DataFrame, keys: Cols, order: str, columns: Cols, name: str = "vector") -> DataFrame:
    """All values of each key in one array, by order and then column; for keys of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.array(*columns).alias("v"))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias(name))


def prefixed(df: DataFrame, columns: Cols, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in columns})


def move_last(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], column)

"""Lookups, encodings by join, pairs and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a dimension. No hint: the optimizer broadcasts it by its bytes, from statistics or as adaptive execution measures them, and shuffles it beyond its threshold."""
    return df.join(dim, list(keys), how)


def members(df: DataFrame, ids: DataFrame, keys: Sequence[str], inside: bool = True) -> DataFrame:
    return df.join(ids, list(keys), "left_semi" if inside else "left_anti")


def align_inner(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def concat_columns(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "full")


def target_means(df: DataFrame, category: str, target: str) -> DataFrame:
    """The fitted encoding: mean target of each category."""
    return df.groupBy(category).agg(F.avg(target).alias(f"{category}_encoded"))


def target_encode(df: DataFrame, category: str, target: str) -> DataFrame:
    return lookup(df, target_means(df, category, target), [category])


def gather_pairs(df: DataFrame, pairs: DataFrame, date: str, key: str, value: str) -> DataFrame:
    """(date, i, j, left, right, spread) for the pairs (i, j) of ids; j = -1 has no counterpart and counts as zero."""
    left = df.select(F.col(date), F.col(key).alias("i"), F.col(value).alias("left"))
    right = df.select(F.col(date), F.col(key).alias("j"), F.col(value).alias("right"))
    got = left.join(pairs, "i").join(right, [date, "j"], "left")
    got = got.filter((F.col("j") == -1) | F.col("right").isNotNull()).withColumn("right", F.coalesce("right", F.lit(0.0)))
    return got.select(date, "i", "j", "left", "right", (F.col("left") - F.col("right")).alias("spread"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """For each left row the last right values at or before its time: one sort of the union, no range join."""
    a = left.withColumns({"_side": F.lit(1), **{f"_r_{c}": F.lit(None).cast(right.schema[c].dataType) for c in columns}})
    b = right.select(*by, time, F.lit(0).alias("_side"), F.struct(*columns).alias("_v"))
    both = a.unionByName(b.select(*by, time, "_side", *[F.col("_v")[c].alias(f"_r_{c}") for c in columns], F.lit(True).alias("_is")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is"), F.struct(*[F.col(f"_r_{c}").alias(c) for c in columns])), True).over(w)
    return both.withColumn("_last", last).filter("_side = 1").select(*left.columns, *[F.col("_last")[c].alias(c) for c in columns])


def kernel_sums(source: DataFrame, target: DataFrame, key: str, vector: str, kernels: int = 5, factor: float = 2.0, parts: int = 64) -> DataFrame:
    """Mean Gaussian kernels within the source, within the target and between them, and their maximum mean discrepancy.

    The linear-time estimator: row i goes with row i + 1, the last one with the first; between sides of different length the shorter one starts
    again from its first row, so every row of both counts. The bandwidth is the mean squared distance of all pairs of rows, in closed form.
    Rows are numbered by slice (the integer key modulo ``parts``), then key: no task orders all of them. Rows without key or vector take no part.
    """
    source, target = (df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()) for df in (source, target))
    sizes = source.count(), target.count()

    def pairs(df: DataFrame, size: int, a: str, b: str) -> DataFrame:
        part = F.pmod(F.col(key), F.lit(parts))
        rows = df.select(part.alias("_s"), F.row_number().over(Window.partitionBy(part).orderBy(key)).alias("_k"), F.col(vector).alias(a))
        first = df.groupBy(part.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))  # at most ``parts`` rows
        first = first.select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_first"))
        rows = rows.join(F.broadcast(first), "_s").select((F.col("_first") + F.col("_k") - 1).alias("_i"), a)
        return rows.join(rows.select(F.pmod(F.col("_i") - 1, F.lit(max(size, 1))).alias("_i"), F.col(a).alias(b)), "_i")

    x, y = pairs(source, sizes[0], "x1", "x2"), pairs(target, sizes[1], "y1", "y2")
    long, short = (x, y) if sizes[0] >= sizes[1] else (y, x)
    both = long.withColumn("_i", F.col("_i") % max(min(sizes), 1)).join(short, "_i")
    apart = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    of = lambda kind, *d: [F.lit(kind).alias("kind"), F.explode(F.array(*d)).alias("d")]
    d = x.select(*of("x", apart("x1", "x2"))).union(y.select(*of("y", apart("y1", "y2")))).union(both.select(*of("xy", apart("x1", "y2"), apart("x2", "y1"))))
    n = sum(sizes)
    every = source.select(vector).union(target.select(vector)).select(F.posexplode(vector).alias("_at", "_v"))
    sums = every.groupBy("_at").agg(F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))  # one row a dimension
    width = sums.agg((2 * (n * F.sum("q") - F.sum(F.col("s") * F.col("s"))) / max(n * (n - 1), 1)).alias("w"))
    d = d.crossJoin(F.broadcast(width))  # one row
    k = sum((F.exp(-F.try_divide(F.col("d"), F.col("w") * factor ** (i - kernels // 2))) for i in range(kernels)), F.lit(0.0))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, k))
    got = d.agg(mean("x").alias("k_source"), mean("y").alias("k_target"), mean("xy").alias("k_between"))
    return got.select(F.lit(max(sizes)).alias("pairs"), "*", F.expr("k_source + k_target - 2 * k_between").alias("mmd"))

"""Cleaning and alignment of series: deduplication, grids, fills, filters, splits.

A series is named by its partition columns ``by`` and ordered by ``order``; nothing
depends on the order of rows in a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

Cols = Sequence[str]


def over(by: Cols, order: Cols) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def existing(df: DataFrame, columns: Cols) -> list[str]:
    """Those of the columns that the frame has, each once, in the given order."""
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def keep_existing(df: DataFrame, columns: Cols) -> DataFrame:
    return df.select(*existing(df, columns))


def drop_existing(df: DataFrame, columns: Cols) -> DataFrame:
    return df.drop(*existing(df, columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value to Spark; a missing value is NULL here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def to_number(df: DataFrame, columns: Cols) -> DataFrame:
    """Cast to double; what is no number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in existing(df, columns)})


def to_text(df: DataFrame, columns: Cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in existing(df, columns)})


def parse_time(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    t = F.to_timestamp_ntz(F.col(column), F.lit(fmt)) if fmt else F.col(column).cast("timestamp_ntz")
    return df.withColumn(column, t)


def keep_last(df: DataFrame, keys: Cols, ordinal: Cols) -> DataFrame:
    """One row of each key: the last by the ordinal columns."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ordinal])
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def time_grid(spark: SparkSession, start: str, end: str, step: str, name: str = "time") -> DataFrame:
    """Instants from start by steps, before end."""
    bounds = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(name), "b").filter(F.col(name) < F.col("b")).select(name)


def own_grid(df: DataFrame, by: Cols, time: str, step: str) -> DataFrame:
    """For each series, instants from its first to its last by steps."""
    span = df.groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return span.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(time))


def on_grid(grid: DataFrame, series: DataFrame, keys: Cols) -> DataFrame:
    """The series' columns at the grid's instants; NULL where there are none."""
    return grid.join(series, list(keys), "left")


def target_series(grid: DataFrame, series: DataFrame, time: str, target: str, numeric: Cols = (), categorical: Cols = (), drop: Cols = (), by: Cols = ()) -> tuple[DataFrame, list[str]]:
    """The target as ``y`` and other observed columns on the grid; also the list of these endogenous columns."""
    out = {time, target, *drop, *by}
    num = [c for c in existing(series, numeric) if c not in out]
    cat = [c for c in existing(series, categorical) if c not in out and c not in num]
    picked = series.select(*by, F.col(time).alias("time"), F.expr(f"try_cast(`{target}` AS double)").alias("y"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in num], *[F.col(c).cast("string").alias(c) for c in cat])
    return on_grid(grid, picked, [*by, "time"]), ["y", *num, *cat]


def interpolate(df: DataFrame, by: Cols, order: Cols, columns: Cols) -> DataFrame:
    """Linear by position between known values; the nearest known value at the edges."""
    w = over(by, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = df.withColumn("_p", F.row_number().over(w))
    helps = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_p"))
        helps |= {f"_a_{c}": F.last(c, True).over(before), f"_ap_{c}": F.last(at, True).over(before), f"_b_{c}": F.first(c, True).over(after), f"_bp_{c}": F.first(at, True).over(after)}
    wide = pos.withColumns(helps)

    def line(c: str) -> Column:
        a, ap, b, bp = (F.col(f"_{k}_{c}") for k in ("a", "ap", "b", "bp"))
        return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * (F.col("_p") - ap) / (bp - ap))

    return wide.withColumns({c: line(c) for c in columns}).drop("_p", *helps)


def fill_forward(df: DataFrame, by: Cols, order: Cols, columns: Cols) -> DataFrame:
    w = over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def fill_backward(df: DataFrame, by: Cols, order: Cols, columns: Cols) -> DataFrame:
    w = over(by, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, True).over(w) for c in columns})


def fill_value(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def sentinel_to_null(df: DataFrame, columns: Cols, sentinel: float = -999999) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in columns})


def missing_mask(df: DataFrame, columns: Cols) -> DataFrame:
    """``{c}_missing`` is 1 where the value is NULL, NaN or zero."""
    return df.withColumns({f"{c}_missing": F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) == 0), 1).otherwise(0) for c in columns})


def drop_missing(df: DataFrame, columns: Cols | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def with_stats(df: DataFrame, by: Cols, stats: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of each row's group as columns: partial sums and a join, so that a group of any size needn't meet in one task as in a window."""
    own = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(*[x.alias(c) for c, x in stats.items()])
    if not by:
        return df.crossJoin(F.broadcast(own))  # one row
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return df.join(own, same).drop(*[f"_by{i}" for i in range(len(by))])


def remove_outliers(df: DataFrame, by: Cols, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose absolute z-score (population deviation) is below the threshold."""
    got = with_stats(df, by, {"_m": F.avg(column), "_s": F.stddev_pop(column)})
    return got.filter(F.abs(F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))) < threshold).drop("_m", "_s")


def between(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Both ends belong."""
    return df.filter(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def with_warm_up(df: DataFrame, time: str, start: str, step: str, rows: int) -> DataFrame:
    """Rows from ``rows`` steps before start: enough for windows of that length, and pushed to the scan, unlike a filter after them."""
    return df.filter(F.col(time) >= F.expr(f"timestamp_ntz'{start}' - {rows} * INTERVAL {step}"))


def split_ratio(df: DataFrame, by: Cols, order: Cols, ratio: float) -> DataFrame:
    """``part`` is train for the first floor(n * ratio) rows of each series, else test."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("part", F.when(F.row_number().over(over(by, order)) <= F.floor(n * ratio), "train").otherwise("test"))


def split_tail(df: DataFrame, by: Cols, order: Cols, size: int) -> DataFrame:
    """``part`` is test for the last ``size`` rows of each series."""
    last = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("part", F.when(F.row_number().over(last) <= size, "test").otherwise("train"))


def split_date(df: DataFrame, time: str, at: str) -> DataFrame:
    return df.withColumn("part", F.when(F.col(time) < F.lit(at).cast("timestamp_ntz"), "train").otherwise("test"))


def hashed_share(keys: Cols, seed: int = 42) -> Column:
    """A number in [0, 1) from the keys' text, the same on every run and after a lost executor; NULL keys are passed over."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def split_random(df: DataFrame, ratio: float, seed: int = 42, keys: Cols | None = None) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the keys (by default of all columns); rows with equal keys stay together."""
    part = hashed_share(keys or df.columns, seed) < ratio
    return df.filter(part), df.filter(~part)


def predictors_and_target(df: DataFrame, predictors: Cols, targets: Cols) -> tuple[DataFrame, list[str], list[str]]:
    """Rows complete in both lists, with these columns only."""
    x, y = existing(df, predictors), existing(df, targets)
    full = df.na.drop(subset=[*x, *y])
    return full.select(*dict.fromkeys([*[c for c in full.columns if c in ("time", "series_id")], *x, *y])), x, y


def add_noise(df: DataFrame, column: str, level: float = 0.01, seed: int | None = 42) -> DataFrame:
    """Multiplicative Gaussian noise."""
    return df.withColumn(column, F.col(column) * (1 + level * (F.randn(seed) if seed is not None else F.randn())))


def extend(history: DataFrame, future: DataFrame, by: Cols, order: Cols) -> DataFrame:
    """History without its last row, then the future."""
    last = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    head = history.withColumn("_n", F.row_number().over(last)).filter("_n > 1").drop("_n")
    return head.unionByName(future, allowMissingColumns=True)

"""Seeded synthetic series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def white_noise(spark: SparkSession, n: int, seed: int = 42, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("t"), (mean + sd * F.randn(seed)).alias("y"))


def random_walk(spark: SparkSession, n: int, seed: int = 42, start: float = 0.0, drift: float = 0.0, noise: bool = True, series: int = 1) -> DataFrame:
    """Cumulated steps for each of ``series`` walks; without noise only the drift remains."""
    e = spark.range(n * series).select((F.col("id") % series).alias("series_id"), F.floor(F.col("id") / series).alias("t"), (F.lit(drift) + (F.randn(seed) if noise else F.lit(0.0))).alias("_e"))
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("series_id", "t", (start + F.sum("_e").over(w)).alias("y"))


def seasonal(spark: SparkSession, n: int, periods: Sequence[float], amplitudes: Sequence[float], noise: float = 0.0, seed: int = 42, quadratic: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Sines of the periods plus a quadratic trend plus noise."""
    t = F.col("id").cast("double")
    y = sum((a * F.sin(2 * F.pi() * t / p) for p, a in zip(periods, amplitudes, strict=True)), F.lit(quadratic[0]) + quadratic[1] * t + quadratic[2] * t * t)
    return spark.range(n).select(F.col("id").alias("t"), (y + (noise * F.randn(seed) if noise else F.lit(0.0))).alias("y"))


def load_and_weather(spark: SparkSession, days: int, seed: int = 42) -> DataFrame:
    """Five-minute load and weather."""
    i = F.col("id")
    day = 2 * F.pi() * (i % 288) / 288
    time = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 5 as int), 0)")
    u = lambda k: F.rand(seed + k)
    return spark.range(288 * days).select(time.alias("data_time"), (100 + 20 * F.sin(day) + 5 * F.randn(seed)).alias("real_power"), (10 * u(1)).alias("wind_speed"), (360 * u(2)).alias("wind_angle"), (15 + 8 * F.sin(day) + F.randn(seed + 3)).alias("temp"), (2 * u(4)).alias("prec"), (1000 + 20 * u(5)).alias("pressure"), (100 * u(6)).alias("clouds"), (14 + 8 * F.sin(day)).alias("feels_like"), (40 + 50 * u(7)).alias("rh"), F.floor(10 * u(8)).cast("int").alias("weather_code"))

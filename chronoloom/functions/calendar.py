"""Calendar, cyclic and arithmetic features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Monday is 0; weeks are ISO weeks.
PARTS = {
    "minute": F.minute,
    "hour": F.hour,
    "day": F.dayofmonth,
    "weekday": F.weekday,
    "week": F.weekofyear,
    "day_of_week": F.weekday,
    "week_of_year": F.weekofyear,
    "month": F.month,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "quarter": F.quarter,
    "day_of_year": F.dayofyear,
    "year": F.year,
}


def calendar(df: DataFrame, time: str, parts: Sequence[str]) -> DataFrame:
    """``dt_{part}`` as int."""
    return df.select("*", *[PARTS[p](F.col(time)).cast("int").alias(f"dt_{p}") for p in parts])


def time_of_day(df: DataFrame, time: str, freq_minutes: int) -> DataFrame:
    """``dt_minute_in_day`` (steps since midnight) and its sine and cosine over a day."""
    step = F.hour(time) * (60 / freq_minutes) + F.minute(time) / freq_minutes
    turn = step * (2 * F.pi() / (1440 / freq_minutes))
    return df.select("*", step.alias("dt_minute_in_day"), F.sin(turn).alias("dt_minute_in_day_sin"), F.cos(turn).alias("dt_minute_in_day_cos"))


def cyclic(df: DataFrame, column: str, period: float) -> DataFrame:
    turn = 2 * F.pi() * F.col(column) / period
    return df.select("*", F.sin(turn).alias(f"{column}_sin"), F.cos(turn).alias(f"{column}_cos"))


def weekend(time: Column) -> Column:
    return (F.weekday(time) >= 5).cast("int")


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]], operations: Sequence[str] = ("add", "substract", "multiply", "divide")) -> DataFrame:
    """``{a}_{op}_{b}``; a division adds 1e-8 to the divisor and is NULL if that is zero."""
    ops = {
        "add": lambda a, b: a + b,
        "substract": lambda a, b: a - b,
        "multiply": lambda a, b: a * b,
        "divide": lambda a, b: F.try_divide(a, b + 1e-8),
    }
    return df.select("*", *[ops[o](F.col(a), F.col(b)).alias(f"{a}_{o}_{b}") for a, b in pairs for o in operations])


def polynomials(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    return df.select("*", *[F.pow(c, F.lit(d)).alias(f"{c}_pow_{d}") for c in columns for d in range(2, degree + 1)])


def fourier(df: DataFrame, turn: Column, order: int, name: str = "year") -> DataFrame:
    """``sin_{name}_{k}`` and ``cos_{name}_{k}`` of a phase given in turns."""
    angle = lambda k: 2 * k * F.pi() * turn
    return df.select("*", *[f(angle(k)).alias(f"{n}_{name}_{k}") for k in range(1, order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))])


def year_turn(time: Column) -> Column:
    """How much of its year has passed, by days."""
    days = F.when(F.dayofyear(F.last_day(F.make_date(F.year(time), F.lit(12), F.lit(1)))) == 366, 366.0).otherwise(365.0)
    return (F.dayofyear(time) - 1) / days


def one_hot(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in values])


def range_label(time: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Aggregate: first and last instant as text, joined by ~."""
    return F.concat_ws("~", F.date_format(F.min(time), fmt), F.date_format(F.max(time), fmt))

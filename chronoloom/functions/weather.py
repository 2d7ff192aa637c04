"""Day types and weather: relative humidity, past and forecast enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.align import existing, interpolate, to_number
from chronoloom.operators.joins import lookup

PAST = ("rt_ssr", "rt_ws10", "rt_tt2", "rt_dt", "rt_ps", "rt_rain")
#: The past column that each forecast column stands for, and what is taken off.
FORECAST = {"pred_ssrd": ("rt_ssr", 0.0), "pred_ws10": ("rt_ws10", 0.0), "pred_tt2": ("rt_tt2", 0.0), "pred_rh": ("cal_rh", 0.0), "pred_ps": ("rt_ps", 50.0), "pred_rain": ("rt_rain", 2.5)}


def vapour_pressure(kelvin: Column) -> Column:
    """Magnus form, hPa."""
    c = kelvin - 273.15
    return 6.1078 * F.exp(17.2693 * c / (237.29 + c))


def relative_humidity(kelvin: Column, dew_kelvin: Column) -> Column:
    share = 100 * vapour_pressure(dew_kelvin) / vapour_pressure(kelvin)
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))


def _one_each(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the greatest by its columns in order, whatever the order of the input."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest]) if rest else df.distinct()


def add_past_weather(series: DataFrame, weather: DataFrame, time: str = "time", weather_time: str = "ts", by: tuple[str, ...] = ("series_id",)) -> tuple[DataFrame, list[str]]:
    """Complete weather rows joined by time, humidity in place of the dew point, gaps interpolated over each series."""
    cols = existing(weather, PAST)
    w = to_number(weather.select(F.col(weather_time).alias(time), *cols).na.drop(), cols)
    added = [c for c in cols if c != "rt_dt"]
    if {"rt_tt2", "rt_dt"} <= set(cols):
        w = w.withColumn("cal_rh", relative_humidity(F.col("rt_tt2"), F.col("rt_dt")))
        added.append("cal_rh")
    w = _one_each(w.drop("rt_dt"), time)
    return interpolate(series.join(w, time, "left"), by, [time], added), added


def add_forecast_weather(grid: DataFrame, weather: DataFrame, time: str = "time", weather_time: str = "ts") -> tuple[DataFrame, list[str]]:
    """Forecast columns under the names of the past ones; pressure and rain are corrected by fixed offsets."""
    picked = to_number(weather, list(FORECAST)).select(F.col(weather_time).alias(time), *[(F.col(c) - off).alias(name) for c, (name, off) in FORECAST.items() if c in weather.columns])
    return grid.join(_one_each(picked, time), time, "left"), [n for c, (n, _) in FORECAST.items() if c in weather.columns]


def add_day_type(series: DataFrame, days: DataFrame, time: str = "time") -> DataFrame:
    """``date_type`` of each instant's day (the greatest, where a day has several)."""
    dim = _one_each(days.select(F.to_date("date").alias("_day"), F.col("date_type").cast("int").alias("date_type")), "_day")
    return lookup(series.withColumn("_day", F.to_date(time)), dim, ["_day"]).drop("_day")

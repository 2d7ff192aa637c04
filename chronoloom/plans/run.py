"""A whole run from a configuration: alignment, enrichment, features, backtest, forecast; one lazy plan until results are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.config import ForecastConfig, freq_minutes
from chronoloom.functions import calendar as cal
from chronoloom.functions import weather as wx
from chronoloom.operators import align, windows
from chronoloom.plans import backtest as bt
from chronoloom.plans import strategies

Cols = Sequence[str]


@dataclass(frozen=True)
class RunResult:
    history: DataFrame  # aligned and enriched
    endogenous: list[str]
    exogenous: list[str]
    predictions: DataFrame | None  # of the backtest
    scores: DataFrame | None  # a row for each series and window, and the mean of each series
    forecast: DataFrame | None


def process_history(cfg: ForecastConfig, bundle: dict[str, DataFrame], by: Cols, time: str) -> tuple[DataFrame, list[str], list[str]]:
    """The target on its grid with day types and weather, filled between known values; also endogenous and exogenous columns."""
    step = f"{freq_minutes(cfg.freq)} minutes"
    raw = align.nan_to_null(align.parse_time(bundle["target_series"], time))
    dup = [c for c in raw.columns if c not in (*by, time)]
    raw = align.keep_last(raw, [*by, time], dup)
    grid = align.own_grid(raw.withColumnRenamed(time, "time"), by, "time", step)
    df, endogenous = align.target_series(grid, raw, time, cfg.target, cfg.numeric, cfg.categorical, cfg.drop, by)
    df = align.interpolate(df, by, ["time"], ["y", *[c for c in endogenous if c in cfg.numeric]])
    exogenous: list[str] = []
    if "date_history" in bundle:
        df, exogenous = wx.add_day_type(df, bundle["date_history"]), ["date_type"]
    if "weather_history" in bundle:
        df, more = wx.add_past_weather(df, bundle["weather_history"], by=tuple(by))
        exogenous += more
    df, more = calendar_columns(cfg, df)
    return df.filter(F.col("y").isNotNull()), endogenous, exogenous + more


def calendar_columns(cfg: ForecastConfig, df: DataFrame) -> tuple[DataFrame, list[str]]:
    df = cal.calendar(df, "time", cfg.datetime_features)
    names = [f"dt_{p}" for p in cfg.datetime_features]
    if {"hour", "minute"} <= set(cfg.datetime_features):
        df = cal.time_of_day(df, "time", freq_minutes(cfg.freq))
        names += ["dt_minute_in_day_sin", "dt_minute_in_day_cos"]
    return df, names


def process_future(cfg: ForecastConfig, history: DataFrame, bundle: dict[str, DataFrame], by: Cols, horizon: int) -> DataFrame:
    """The steps after each series' last one, with calendar, day types and forecast weather."""
    step = f"INTERVAL {freq_minutes(cfg.freq)} MINUTE"
    last = history.groupBy(*by).agg(F.max("time").alias("_t"))
    grid = last.select(*by, F.explode(F.expr(f"sequence(_t + {step}, _t + {horizon} * {step}, {step})")).alias("time"))
    if "date_future" in bundle:
        grid = wx.add_day_type(grid, bundle["date_future"])
    if "weather_future" in bundle:
        grid, _ = wx.add_forecast_weather(grid, bundle["weather_future"])
    return calendar_columns(cfg, grid)[0]


def create_features(cfg: ForecastConfig, df: DataFrame, by: Cols, endogenous: Cols, exogenous: Cols) -> tuple[DataFrame, list[str]]:
    """Lags of what the method uses; the predictors' names with the exogenous ones."""
    own = [] if cfg.method == "USMDO" else ["y"] if cfg.method.startswith("U") else list(endogenous)
    wide = windows.lags(df, by, ["time"], own, cfg.lags) if own else df
    return wide, [f"{c}_lag_{k}" for c in own for k in cfg.lags] + list(exogenous)


def run(cfg: ForecastConfig, bundle: dict[str, DataFrame], by: Cols = ("series_id",), time: str = "time", mode: str = "origin", windows_limit: int | None = None, purge: int = 0) -> RunResult:
    """``mode``: ``origin`` predicts each window from its start only by the configured method, ``one_step`` every row from true past values.

    The forecast and the windows in mode ``origin`` are the same fit, one model a series (``backtest.method_kernel``): the forecast's on all
    of its history, a window's on its training part, so the scores are those of the method that forecasts.
    """
    if mode not in ("origin", "one_step"):
        raise ValueError(f"unknown mode: {mode}")
    per_day = 1440 // freq_minutes(cfg.freq)
    horizon, length = cfg.predict_days * per_day, cfg.window_days * per_day
    history, endogenous, exogenous = process_history(cfg, bundle, by, time)
    numeric = [c for c in endogenous if c not in cfg.categorical]
    predictions = scores = forecast = None
    if cfg.test:
        bounds = bt.window_bounds(history, by, length, horizon, windows_limit, purge)
        if mode == "one_step":
            wide, features = create_features(cfg, history, by, numeric, exogenous)
            predictions = bt.backtest(wide, bounds, by, "y", features)
        else:
            predictions = bt.backtest_method(history, bounds, by, "y", numeric, exogenous, cfg.lags, cfg.method)
        each = bt.scores(predictions.na.drop(subset=["predict_value"]), [*by, "window"]).withColumn("window", F.col("window").cast("string"))
        names = [c for c in each.columns if c not in (*by, "window")]
        mean = each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names]).withColumn("window", F.lit("mean"))
        scores = each.unionByName(mean)
    if cfg.forecast:
        future = process_future(cfg, history, bundle, by, horizon)
        forecast = bt.forecast_method(history, future, by, "y", numeric, strategies.available(future, exogenous), cfg.lags, cfg.method)
    return RunResult(history, endogenous, exogenous, predictions, scores, forecast)

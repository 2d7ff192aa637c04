"""Configuration of a forecast run and the scalars that follow from it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

#: Minutes of the frequency units.
_UNITS = {"min": 1, "t": 1, "h": 60, "d": 1440, "w": 10080}


def freq_minutes(freq: str) -> int:
    """Minutes of an alias such as ``5min``, ``h`` or ``2D``."""
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq.strip())
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"unknown frequency: {freq}")
    return int(m[1] or 1) * _UNITS[m[2].lower()]


@dataclass(frozen=True)
class ForecastConfig:
    """What a run needs to know; ``lags`` has no default on purpose."""

    target: str
    lags: tuple[int, ...]
    freq: str = "5min"
    history_days: int = 31
    predict_days: int = 1
    window_days: int = 15
    method: str = "USMR"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    datetime_features: tuple[str, ...] = ("hour", "weekday", "month")
    model: str = "ridge"
    model_params: dict = field(default_factory=dict)
    scaler: str | None = None
    test: bool = True
    forecast: bool = True

    def __post_init__(self) -> None:
        if any(k < 1 for k in self.lags):
            raise ValueError("lags start at 1")
        if min(self.history_days, self.predict_days, self.window_days) < 1:
            raise ValueError("days start at 1")
        freq_minutes(self.freq)


@dataclass(frozen=True)
class RunPlan:
    n_per_day: int
    horizon: int
    window_len: int
    n_windows: int
    start: datetime
    now: datetime
    future: datetime


def plan_run(cfg: ForecastConfig, now: datetime) -> RunPlan:
    """The derived scalars: points a day, horizon, window length, number of windows and the three anchors."""
    per_day = 1440 // freq_minutes(cfg.freq)
    horizon, length = cfg.predict_days * per_day, cfg.window_days * per_day
    windows = max(0, (cfg.history_days * per_day - length - horizon + 1) // horizon)
    now = now.replace(minute=0, second=0, microsecond=0)
    return RunPlan(per_day, horizon, length, windows, now.replace(hour=0) - timedelta(days=cfg.history_days), now, now + timedelta(days=cfg.predict_days))


def from_yaml(text: str, **over: object) -> ForecastConfig:
    """A configuration from flat ``key: value`` lines; lists in brackets."""
    values: dict = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if ":" not in line:
            continue
        key, raw = (x.strip() for x in line.split(":", 1))
        if raw.startswith("["):
            values[key] = tuple(_scalar(x) for x in raw.strip("[]").split(",") if x.strip())
        elif raw:
            values[key] = _scalar(raw)
    known = ForecastConfig.__dataclass_fields__
    return ForecastConfig(**{k: v for k, v in (values | over).items() if k in known})


def _scalar(raw: str) -> object:
    raw = raw.strip().strip("'\"")
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(raw.lower(), raw)

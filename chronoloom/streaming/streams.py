"""Structured Streaming forms: window alarms, resampling, stateful point checks, scoring."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.aggregates import limits
from chronoloom.session import shared_folder


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_watermark(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """A watermark needs an instant with a zone; under a UTC session the cast keeps the wall clock."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def resample(stream: DataFrame, time: str, step: str, column: str, keys: tuple[str, ...] = (), delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(time, step, slide) if slide else F.window(time, step)
    return with_watermark(stream, time, delay).groupBy(w, *keys).agg(F.avg(column).alias("y"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias(time), *keys, "y", "n")


def window_alarm(stream: DataFrame, time: str, column: str, mean_low: float, mean_high: float, var_high: float, step: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    got = with_watermark(stream, time, delay).groupBy(F.window(time, step)).agg(F.avg(column).alias("mean"), F.var_pop(column).alias("var"), limits(stream, column, mean_low, mean_high, var_high).alias("alarm"))
    return got.select(F.col("window.start").alias(time), "mean", "var", "alarm")


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    got = with_watermark(stream, time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Rows that ``point_check`` returns at once.
POINTS = 10_000


def point_check(stream: DataFrame, key: str, time: str, column: str, window: int = 24, k: float = 3.0, delay: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Each value against the last ``window`` ones of its series, kept as state; an anomaly doesn't enter the state.

    The state of a series goes once the watermark is ``idle_ms`` past its last value; it begins anew with the next one. Of a series' rows in a
    micro-batch a task holds times and values only, some 50 bytes a row while it sorts them.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        last = state.get[1] if state.exists else 0
        parts = [(b[time].to_numpy("datetime64[ns]"), b[column].to_numpy(float)) for b in batches]
        times, values = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        del order
        for i in range(0, len(times), POINTS):
            v = values[i : i + POINTS]
            smooth, odd = np.full(len(v), np.nan), np.zeros(len(v), bool)
            for j, x in enumerate(v.tolist()):
                if len(past) == window:
                    smooth[j] = mean = float(np.mean(past))
                    odd[j] = abs(x - mean) > k * float(np.std(past))
                past = (past + [float(smooth[j]) if odd[j] else x])[-window:]
            yield pd.DataFrame({key: name[0], time: times[i : i + POINTS], column: v, "smooth": smooth, "is_anomaly": odd})
        last = max(last, int(times[-1].astype("int64") // 1_000_000))
        state.update((past, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))

    kind, t = stream.schema[key].dataType.simpleString(), stream.schema[time].dataType
    schema = f"{key} {kind}, {time} timestamp, {column} double, smooth double, is_anomaly boolean"
    got = with_watermark(stream, time, delay).groupBy(key).applyInPandasWithState(run, schema, "past array<double>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return got.withColumn(time, F.col(time).cast(t))


class RecursiveRegression(StatefulProcessor):
    """Recursive least squares in typed state: every observation is forecast by the model so far and then updates it.

    State is one row a series: the weights (intercept first), their covariance (row by row), the number of observations
    and the time of the last one. In event time a timer closes a series when the watermark is ``idle`` milliseconds past its
    last observation: a row without a target reports its final weights, and the state goes. In processing time the
    state lives for ``idle`` milliseconds after its last update.
    """

    def __init__(self, key: str, time: str, target: str, features: Sequence[str], forgetting: float, spread: float, idle: int, event_time: bool):
        self.key, self.time, self.target, self.features = key, time, target, list(features)
        self.forgetting, self.spread, self.idle, self.event_time = forgetting, spread, idle, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("model", "w array<double>, p array<double>, n bigint, last bigint", None if self.event_time else self.idle)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame(rows, columns=[self.time, self.target, "predict_value", "n", "weights", "closed"])
        got[self.time] = pd.to_datetime(got[self.time])
        got.insert(0, self.key, key[0])
        return got

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        k = len(self.features) + 1
        if self.state.exists():
            w, p, n, last = self.state.get()
            w, p = np.array(w), np.array(p).reshape(k, k)
        else:
            w, p, n, last = np.zeros(k), self.spread * np.eye(k), 0, None
        for pdf in rows:
            pdf = pdf.sort_values([self.time, self.target, *self.features], kind="stable")
            times, y = pdf[self.time].to_numpy("datetime64[ms]").astype("int64"), pdf[self.target].to_numpy(float)
            x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in self.features]])
            out = []
            for t, at, xi, yi in zip(pdf[self.time], times, x, y, strict=True):
                if not (np.isfinite(xi).all() and np.isfinite(yi)):
                    continue
                guess = float(w @ xi) if n else None
                px = p @ xi
                gain = px / (self.forgetting + xi @ px)
                w = w + gain * (yi - w @ xi)
                p = (p - np.outer(gain, px)) / self.forgetting
                p = (p + p.T) / 2
                n, last = n + 1, int(at) if last is None else max(last, int(at))
                out.append((t, float(yi), guess, n, w.tolist(), False))
            if out:
                yield self._rows(key, out)
        if n:
            self.state.update((w.tolist(), p.ravel().tolist(), int(n), last))
            if self.event_time:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            w, _, n, last = self.state.get()
            self.state.clear()
            yield self._rows(key, [(pd.Timestamp(last, unit="ms"), None, None, int(n), list(w), True)])


def online_regression(stream: DataFrame, key: str, time: str, target: str, features: Sequence[str], delay: str = "1 hour", idle_ms: int = 86_400_000, forgetting: float = 1.0, spread: float = 1.0, event_time: bool = True) -> DataFrame:
    """(key, time, target, predict_value, n, weights, closed): a row for each observation, from a model of its series that it then updates.

    With ``forgetting`` 1 the weights are those of ridge regression with penalty 1 / ``spread`` over all observations so far, in whatever order
    they came. Observations behind the watermark are late and leave no trace; those with missing or infinite numbers neither.
    Runs in append mode and needs STATE as settings (``run_to_end(..., settings=STATE)``). In processing time a stream always has another batch to
    run, so it is started and stopped by hand.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = with_watermark(stream, time, delay).select(key, time, F.col(target).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in features])
    made = RecursiveRegression(key, time, target, features, forgetting, spread, idle_ms, event_time)
    schema = f"`{key}` {kind}, `{time}` timestamp, `{target}` double, predict_value double, n bigint, weights array<double>, closed boolean"
    return rows.groupBy(key).transformWithStateInPandas(made, schema, "append", "eventTime" if event_time else "processingTime")


#: What typed state needs of the session.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_end(stream: DataFrame, name: str, mode: str, spark: SparkSession, folder: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """All available input through a query whose micro-batches are written as Parquet under ``folder`` (by default the session's shared one).

    A batch that is run again overwrites its own rows. In complete mode the last batch is the result, otherwise all of them are.
    ``settings`` hold while the stream runs; the session has its own again afterwards.
    """
    top = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/{k}")
        done.append(k)

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not done:
        return spark.createDataFrame([], stream.schema)
    picked = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{top}/rows/{k}" for k in picked])


def score_request(spark: SparkSession, model, params: dict[str, float]) -> DataFrame:
    """One row from a dict of parameters through a fitted model."""
    return model.predict(spark.createDataFrame([tuple(float(v) for v in params.values())], ", ".join(f"`{k}` double" for k in params)))

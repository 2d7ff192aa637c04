"""Streams in append mode: a model that each observation updates, late rows, closed series and evicted state."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.streaming import streams

T0 = datetime(2024, 1, 1)
SCHEMA = "sid string, time timestamp, y double, a double, b double"


def write(spark, path, batches):
    """A file for each batch, read in the order of their names."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def observations(seed, sid, hours):
    r = np.random.default_rng(seed)
    return [(sid, T0 + timedelta(hours=int(h)), float(2 + 3 * a - b + r.normal(0, 0.1)), float(a), float(b)) for h, (a, b) in zip(hours, r.normal(size=(len(hours), 2)), strict=True)]


def ridge(rows, spread=1.0):
    x = np.array([[1.0, r[3], r[4]] for r in rows])
    return np.linalg.solve(x.T @ x + np.eye(3) / spread, x.T @ np.array([r[2] for r in rows]))


def run(spark, stream, **kw):
    got = streams.online_regression(stream, "sid", "time", "y", ["a", "b"], **kw)
    return streams.run_to_end(got, "online", "append", spark, settings=streams.STATE).collect()


def test_weights_equal_a_batch_fit(spark, tmp_path):
    one, two = observations(1, "one", range(60)), observations(2, "two", range(0, 120, 2))
    bad = [("one", T0 + timedelta(hours=30), None, 1.0, 1.0), ("one", T0 + timedelta(hours=30), 1.0, float("nan"), 1.0), ("one", T0 + timedelta(hours=31), float("inf"), 1.0, 1.0)]
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = run(spark, write(spark, str(tmp_path / "in"), [one[:20] + two[:10], one[20:50] + bad + two[10:30], one[50:] + two[30:]]), idle_ms=10**12)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == conf
    for name, rows in (("one", one), ("two", two)):
        own = sorted((r for r in got if r.sid == name), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(rows) + 1)) and not any(r.closed for r in own)
        assert np.allclose(own[-1].weights, ridge(rows), atol=1e-9)
        assert own[0].predict_value is None
        for k in (5, 25, len(rows) - 1):  # each forecast is of the model before
            w = ridge(rows[:k])
            assert own[k].predict_value == pytest.approx(w @ [1.0, rows[k][3], rows[k][4]]) and own[k].y == rows[k][2]


def test_late_rows_leave_no_trace_and_idle_series_close(spark, tmp_path):
    early, rest = observations(3, "a", range(10)), observations(4, "b", range(5, 60))
    late, again = observations(5, "a", [3, 4]), observations(6, "a", [58, 59])
    got = run(spark, write(spark, str(tmp_path / "in"), [early, rest[:50], late + rest[50:], again]), delay="1 hour", idle_ms=3_600_000)
    a = sorted((r for r in got if r.sid == "a"), key=lambda r: (r.time, r.n))
    closed = [r for r in a if r.closed]
    # The first ten close the series; what comes late is dropped; the last two begin anew.
    assert len(closed) == 1 and closed[0].n == 10 and np.allclose(closed[0].weights, ridge(early)) and closed[0].y is None
    assert [r.n for r in a if not r.closed] == [*range(1, 11), 1, 2]
    assert np.allclose(a[-1].weights, ridge(again))
    assert max(r.n for r in got if r.sid == "b") == 55


def test_state_that_lives_for_a_time(spark, tmp_path):
    rows = observations(7, "a", range(8))
    stream = write(spark, str(tmp_path / "in"), [rows[:4], rows[4:]])
    made = streams.online_regression(stream, "sid", "time", "y", ["a", "b"], event_time=False, idle_ms=600_000, forgetting=0.9)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, v in streams.STATE.items():
            spark.conf.set(k, v)
        query = made.writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(90):
            if query.awaitTermination(1) or spark.table("lives").count() >= 8:
                break
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.table("lives").collect()
    assert sorted(r.n for r in got) == list(range(1, 9))
    x, y = np.array([[1.0, r[3], r[4]] for r in rows]), np.array([r[2] for r in rows])
    w = 0.9 ** np.arange(7, -1, -1)
    want = np.linalg.solve(x.T @ (w[:, None] * x) + 0.9**8 * np.eye(3), x.T @ (w * y))
    assert np.allclose(max(got, key=lambda r: r.n).weights, want)


def test_nothing(spark, tmp_path):
    assert run(spark, write(spark, str(tmp_path / "in"), [[]])) == []


def test_append_mode_drops_late_rows_and_evicts(spark, tmp_path):
    rows = observations(8, "a", range(12))
    late = [("a", T0 + timedelta(hours=2, minutes=30), 1e9, 0.0, 0.0)]
    near = [("a", T0 + timedelta(hours=11, minutes=30), 5.0, 0.0, 0.0)]
    stream = write(spark, str(tmp_path / "in"), [rows, near, late, observations(9, "a", [20])])  # a batch is late by the watermark of two batches before
    got = streams.run_to_end(streams.resample(stream, "time", "1 hour", "y", ("sid",), delay="2 hours"), "append", "append", spark).collect()
    by = {r.time: r for r in got}
    assert len(by) == len(got) == 12 and T0 + timedelta(hours=20) not in by  # the last window is still open
    assert by[T0 + timedelta(hours=2)].n == 1 and by[T0 + timedelta(hours=11)].n == 2
    assert by[T0 + timedelta(hours=2)].y == pytest.approx(rows[2][2])


def test_alarms_in_append_mode(spark, tmp_path):
    stream = write(spark, str(tmp_path / "in"), [[("a", T0, 1.0, 0.0, 0.0), ("a", T0 + timedelta(minutes=5), 99.0, 0.0, 0.0)], [("a", T0 + timedelta(hours=9), None, 0.0, 0.0)]])
    got = streams.run_to_end(streams.window_alarm(stream, "time", "y", 0, 60, 100), "alarm", "append", spark)
    assert [(r.mean, r["var"], r.alarm) for r in got.select("mean", "var", F.col("alarm")).collect()] == [(50.0, 2401.0, True)]


def test_point_check_forgets_idle_series(spark, tmp_path):
    at = lambda sid, hours, y: [(sid, T0 + timedelta(hours=h), float(v), 0.0, 0.0) for h, v in zip(hours, y, strict=True)]
    first = at("a", range(5), [1, 2, 1, 2, 1]) + at("b", range(5), [1, 2, 1, 2, 1])
    more = at("b", range(20, 22), [2, 90])
    stream = write(spark, str(tmp_path / "in"), [first, more, at("b", [40], [1]), at("a", [41], [90]) + at("b", [41], [90])])
    got = streams.run_to_end(streams.point_check(stream, "sid", "time", "y", window=4, delay="1 hour", idle_ms=6 * 3_600_000), "points", "append", spark).collect()
    by = {(r.sid, r.time): r for r in got}
    assert len(by) == len(got) == 15
    hour = lambda h: T0 + timedelta(hours=h)
    assert by["b", hour(4)].smooth == 1.5 and not by["b", hour(4)].is_anomaly
    assert by["a", hour(41)].smooth is None and not by["a", hour(41)].is_anomaly  # forgotten, so begun anew


def test_point_check_holds_no_rows_as_objects(spark, tmp_path, monkeypatch):
    """A series' rows in a micro-batch are sorted as numbers and returned in parts; the rows are those of one step at a time."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    held = []
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, run, *a: held.append(run) or spark.createDataFrame([], a[0]))
    spark.createDataFrame([("a", None, 1.0)], "sid string, time timestamp, y double").write.parquet(str(tmp_path / "s"))
    streams.point_check(spark.readStream.schema("sid string, time timestamp, y double").parquet(str(tmp_path / "s")), "sid", "time", "y", window=4, k=1.5)
    n, r = 60_000, np.random.default_rng(2)
    at, y = r.permutation(n), r.normal(0, 1, n)
    put = []
    state = SimpleNamespace(hasTimedOut=False, exists=False, update=put.append, setTimeoutTimestamp=put.append, getCurrentWatermarkMs=lambda: 0)
    batches = (pd.DataFrame({"sid": "a", "time": pd.to_datetime(at[i : i + 5000], unit="s"), "y": y[i : i + 5000]}) for i in range(0, n, 5000))
    tracemalloc.start()
    sizes, first = [], []
    for out in held[0](("a",), batches, state):
        sizes.append(len(out))
        first += out.head(300).itertuples(index=False) if not first else []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n and max(sizes) <= 10_000 and put[0][1] == (n - 1) * 1000 and peak < 100 * n
    past = []
    for got, v in zip(first, y[np.argsort(at)], strict=False):
        mean = np.mean(past) if len(past) == 4 else np.nan
        odd = len(past) == 4 and abs(v - mean) > 1.5 * np.std(past)
        assert got.y == v and got.is_anomaly == odd and (np.isnan(got.smooth) if np.isnan(mean) else got.smooth == mean)
        past = [*past, mean if odd else v][-4:]

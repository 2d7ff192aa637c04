"""Anomaly detection, smoothing, deterministic terms, forecasting, backtests, ensembles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import anomaly as ad
from chronoloom.operators import smooth
from chronoloom.operators import windows
from chronoloom.operators.align import drop_missing, interpolate
from chronoloom.plans import backtest as bt
from chronoloom.plans import deterministic as det
from chronoloom.plans import ensemble as ens
from chronoloom.plans import learners
from chronoloom.plans import statistical as sta
from chronoloom.plans import strategies as fc
from chronoloom.functions import calendar as cal
from chronoloom.queries.base import BY, DAILY, HOURLY, ORDER, SHIPPED, TYPED, W, daily, hourly, query, shipped, supplied, table, typed
from chronoloom.queries.fitted_sql import CUT, PAST, SQL, searched
from chronoloom.streaming import streams

Z = "abs((x - avg(x) OVER w) / stddev_pop(x) OVER w)"


@query("nsigma", "sid time is_anomaly", f"WITH {TYPED}\n---\nSELECT sid, time, coalesce(y <= avg(y) OVER w - 2 * stddev_samp(y) OVER w OR y >= avg(y) OVER w + 2 * stddev_samp(y) OVER w, false) AS is_anomaly FROM ty WINDOW w AS (PARTITION BY sid)")
def nsigma(spark, d):
    return ad.n_sigma(typed(spark, d), BY, "y", 2.0)


@query("zscore_flag", "sid time y_zscore:d y_isanomaly", f"WITH {TYPED}, z AS (SELECT sid, time, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS z FROM ty WINDOW w AS (PARTITION BY sid))\n---\nSELECT sid, time, z AS y_zscore, coalesce(abs(z) >= 1.5, false) AS y_isanomaly FROM z")
def zscore_flag(spark, d):
    return ad.z_score(typed(spark, d), BY, "y", 1.5)


@query("zscore_one_sided", "sid time y_isanomaly", f"WITH {TYPED}\n---\nSELECT sid, time, coalesce((y - avg(y) OVER w) / stddev_pop(y) OVER w >= 1.0, false) AS y_isanomaly FROM ty WINDOW w AS (PARTITION BY sid)")
def zscore_one_sided(spark, d):
    return ad.z_score(typed(spark, d), BY, "y", 1.0, two_sided=False)


FENCE = "(SELECT sid, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t} GROUP BY sid)"


@query("boxplot", "sid time n_out:i is_anomaly", f"WITH {SHIPPED}\n---\nSELECT s.sid, s.time, CASE WHEN rev < a - 1.5 * (b - a) OR rev > b + 1.5 * (b - a) THEN 1 ELSE 0 END AS n_out, rev < a - 1.5 * (b - a) OR rev > b + 1.5 * (b - a) AS is_anomaly FROM s JOIN {FENCE.format(c='rev', t='s')} f ON s.sid = f.sid")
def boxplot(spark, d):
    return ad.box_outliers(shipped(spark, d), BY, ["rev"])


@query("multi_box", "sid time n_out:i is_anomaly", f"WITH {SHIPPED}, q AS {FENCE.format(c='qty', t='s')}, r AS {FENCE.format(c='rev', t='s')}, n AS (SELECT s.sid, s.time, (CASE WHEN qty < q.a - 1.5 * (q.b - q.a) OR qty > q.b + 1.5 * (q.b - q.a) THEN 1 ELSE 0 END) + (CASE WHEN rev < r.a - 1.5 * (r.b - r.a) OR rev > r.b + 1.5 * (r.b - r.a) THEN 1 ELSE 0 END) AS n FROM s JOIN q ON s.sid = q.sid JOIN r ON s.sid = r.sid)\n---\nSELECT sid, time, n AS n_out, n > 1 AS is_anomaly FROM n")
def multi_box(spark, d):
    return ad.box_outliers(shipped(spark, d), BY, ["qty", "rev"], 1)


@query("winsorize", "sid time rev:d", f"WITH {SHIPPED}, f AS (SELECT quantile_cont(rev, 0.75) + 1.5 * (quantile_cont(rev, 0.75) - quantile_cont(rev, 0.25)) AS top FROM s)\n---\nSELECT sid, time, least(rev, top) AS rev FROM s, f")
def winsorize(spark, d):
    return ad.winsorize(shipped(spark, d), ["rev"])


@query("threshold", "event_id:l value:d", "SELECT event_id, value FROM events WHERE value < 1 OR value > 150")
def threshold(spark, d):
    return ad.beyond(table(spark, d, "events"), "value", 1, 150)


@query("window_alarm", "event_type ts mean:d var:d alarm", "SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS mean, var_pop(value) AS var, avg(value) < 60 OR avg(value) > 240 OR var_pop(value) > 18000 AS alarm FROM events GROUP BY 1, 2")
def window_alarm(spark, d):
    return ad.window_alarm(table(spark, d, "events"), ["event_type"], "ts", "value", "30 minutes", 60, 240, 18_000)


@query("corr_alarm", "sid corr:d alarm", f"WITH {SHIPPED}\n---\nSELECT sid, corr(disc, rev) AS corr, corr(disc, rev) < 0.5 AS alarm FROM s GROUP BY sid")
def corr_alarm(spark, d):
    return ad.correlation_alarm(shipped(spark, d), BY, "disc", "rev")


@query("residual_z", "sid time residual:d residual_z:d is_anomaly", f"WITH {SHIPPED}, r AS (SELECT sid, time, rev - (avg(rev) OVER w + covar_samp(rev, qty) OVER w / var_samp(qty) OVER w * (qty - avg(qty) OVER w)) AS e FROM s WINDOW w AS (PARTITION BY sid))\n---\nSELECT sid, time, e AS residual, e / stddev_samp(e) OVER w AS residual_z, abs(e / stddev_samp(e) OVER w) > 3 AS is_anomaly FROM r WINDOW w AS (PARTITION BY sid)")
def residual_z(spark, d):
    return ad.residual_z(shipped(spark, d), BY, "qty", "rev")


BAND = f"""e AS (SELECT *, y - smooth AS e FROM b), r AS (SELECT *, CASE WHEN count(e) OVER f = 24 THEN stddev_pop(e) OVER f END AS s FROM e WINDOW f AS ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
---
SELECT time, smooth, smooth - 2 * s AS low, smooth + 2 * s AS high, coalesce(y < smooth - 2 * s OR y > smooth + 2 * s, false) AS is_anomaly FROM r"""


@query("conv_band", "time smooth:d low:d high:d is_anomaly", f"WITH {HOURLY}, b AS (SELECT *, CASE WHEN count(y) OVER f = 24 THEN avg(y) OVER f END AS smooth FROM h WINDOW f AS ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), {BAND}")
def conv_band(spark, d):
    return ad.mean_band(hourly(spark, d), BY, ORDER, "y", 24)


EXP = [0.4 * 0.6**i for i in range(24)]


@query("exp_band", "time smooth:d low:d high:d is_anomaly", f"WITH {HOURLY}, b AS (SELECT *, " + " + ".join(f"lag(y, {i + 1}) OVER ({W}) * {x / sum(EXP)!r}::DOUBLE" for i, x in enumerate(EXP)) + f" AS smooth FROM h), {BAND}")
def exp_band(spark, d):
    return ad.exponential_band(hourly(spark, d), BY, ORDER, "y", 24)


@query("seasonal_band", "time smooth:d is_anomaly", f"WITH {HOURLY}, t AS (SELECT *, (row_number() OVER ({W}) - 1) % 24 AS p, avg(y) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS trend FROM h), b AS (SELECT *, trend + avg(y - trend) OVER (PARTITION BY sid, p) AS smooth FROM t)\n---\nSELECT time, smooth, abs(y - smooth) > 2.5 * stddev_pop(y - smooth) OVER (PARTITION BY sid) AS is_anomaly FROM b")
def seasonal_band(spark, d):
    return ad.seasonal_band(hourly(spark, d), BY, ORDER, "y", 24)


@query("shifting_band", "sid:l time smooth:d is_anomaly", SQL["shifting_band"])
def shifting_band(spark, d):
    return ad.shifting_band(supplied(spark, d), BY, "time", "y", 24, 2.0)


@query("knn_distance", "sid time knn_mean:d knn_max:d", f"WITH {SHIPPED}, p AS (SELECT a.sid, a.time, min(abs(a.rev - b.rev), 5) AS d FROM s a JOIN s b ON a.sid = b.sid AND a.time <> b.time GROUP BY 1, 2)\n---\nSELECT sid, time, list_avg(d) AS knn_mean, list_max(d) AS knn_max FROM p")
def knn_distance(spark, d):
    return ad.knn_distance(shipped(spark, d), BY, "time", "rev", 5)


@query("vector_knn", "vec_id:l knn_mean:d knn_max:d", "WITH p AS (SELECT q.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS n FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)\n---\nSELECT vec_id, avg(d) AS knn_mean, max(d) AS knn_max FROM p WHERE n <= 5 GROUP BY vec_id")
def vector_knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return ad.vector_knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("dbscan_core", "sid time n_near:l is_core", f"WITH {SHIPPED}\n---\nSELECT sid, time, count(*) OVER f AS n_near, count(*) OVER f >= 10 AS is_core FROM s WINDOW f AS (PARTITION BY sid ORDER BY qty RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def dbscan_core(spark, d):
    return ad.dbscan_core(shipped(spark, d), BY, "time", "qty", 5.0, 10)


@query("dbscan", "sid time cluster:i")
def dbscan(spark, d):
    return ad.dbscan(shipped(spark, d), BY, "time", ["qty", "rev"], 25.0, 5)


def _density(kind, k):
    def run(spark, d):
        return ad.density(drop_missing(typed(spark, d), ["y"]), BY, "time", "y", kind, k)

    return run


for _kind, _k in (("lof", 50), ("cof", 20), ("sos", 30)):
    query(_kind, "sid time score:d", SQL.get(_kind))(_density(_kind, _k))


@query("grubbs", "sid time is_anomaly")
def grubbs(spark, d):
    return ad.grubbs(drop_missing(typed(spark, d), ["y"]), BY, "time", "y")


@query("iforest", "sid time score:d is_anomaly")
def iforest(spark, d):
    return ad.isolation_forest(shipped(spark, d), BY, ["qty", "rev"])


@query("one_class", "sid time score:d is_anomaly")
def one_class(spark, d):
    return ad.one_class(shipped(spark, d), BY, ["qty", "rev"])


@query("pca_score", "sid time major_score:d minor_score:d reconstruction:d is_anomaly", SQL["pca_score"])
def pca_score(spark, d):
    got = ad.pca_scores(shipped(spark, d), ["qty", "rev", "disc"], 1)
    return got.withColumn("reconstruction", F.round("reconstruction", 4))  # in the thousands, where six digits are beyond what sums of squares agree on


@query("kmeans_window", "time score:d")
def kmeans_window(spark, d):
    return ad.kmeans_windows(hourly(spark, d), BY, ORDER, "y")


@query("mahalanobis", "sid time distance:d", f"WITH {SHIPPED}, m AS (SELECT avg(qty) AS ma, avg(rev) AS mb, var_samp(qty) AS va, var_samp(rev) AS vb, covar_samp(qty, rev) AS c FROM s)\n---\nSELECT sid, time, (vb * (qty - ma) ** 2 - 2 * c * (qty - ma) * (rev - mb) + va * (rev - mb) ** 2) / (va * vb - c * c) AS distance FROM s, m")
def mahalanobis(spark, d):
    return ad.mahalanobis(shipped(spark, d), "qty", "rev")


ZS = "(SELECT sid, time, (qty - avg(qty) OVER ()) / stddev_pop(qty) OVER () AS a, (rev - avg(rev) OVER ()) / stddev_pop(rev) OVER () AS b, (disc - avg(disc) OVER ()) / stddev_pop(disc) OVER () AS c FROM s)"


@query("score_combine", "sid time average:d maximum:d median:d aom:d moa:d", f"WITH {SHIPPED}, z AS {ZS}\n---\nSELECT sid, time, (a + b + c) / 3 AS average, greatest(a, b, c) AS maximum, a + b + c - greatest(a, b, c) - least(a, b, c) AS median, (greatest(a, b) + c) / 2 AS aom, greatest((a + b) / 2, c) AS moa FROM z")
def score_combine(spark, d):
    return ad.combine_scores(shipped(spark, d), ["qty", "rev", "disc"])


@query("moving_avg_smooth", "time smooth:d", f"WITH {HOURLY}, p AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n, y FROM h), r AS (SELECT *, least(i, n - 1 - i, 5) AS r FROM p)\n---\nSELECT a.time, avg(b.y) AS smooth FROM r a JOIN p b ON b.i BETWEEN a.i - a.r AND a.i + a.r GROUP BY a.time")
def moving_avg_smooth(spark, d):
    return smooth.moving_average(hourly(spark, d), BY, ORDER, "y", 11)


MED = "x AS (SELECT time, y, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM h)"


@query("moving_median_smooth", "time smooth:d", f"WITH {HOURLY}, {MED}, m AS (SELECT *, median(y) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM x)\n---\nSELECT time, CASE WHEN i < n - 5 THEN m ELSE (SELECT m FROM m WHERE i = n - 6) END AS smooth FROM m")
def moving_median_smooth(spark, d):
    return smooth.moving_median(hourly(spark, d), BY, ORDER, "y", 5, "left")


@query("moving_median_right", "time smooth:d", f"WITH {HOURLY}, {MED}, m AS (SELECT *, median(y) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM x)\n---\nSELECT time, CASE WHEN i >= 5 THEN m ELSE (SELECT m FROM m WHERE i = 5) END AS smooth FROM m")
def moving_median_right(spark, d):
    return smooth.moving_median(hourly(spark, d), BY, ORDER, "y", 5, "right")


@query("moving_median_circle", "time smooth:d", f"WITH {HOURLY}, {MED}, c AS (SELECT time, y, i FROM x UNION ALL SELECT NULL, y, n + 4 - i FROM x WHERE i < 5)\n---\nSELECT * FROM (SELECT time, median(y) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS smooth FROM c) WHERE time IS NOT NULL")
def moving_median_circle(spark, d):
    return smooth.moving_median(hourly(spark, d), BY, ORDER, "y", 5, "circle")


@query("on_off", "time smooth:i", f"WITH {HOURLY}\n---\nSELECT time, CASE WHEN min(y) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 40 THEN 1 ELSE 0 END AS smooth FROM h")
def on_off(spark, d):
    return smooth.on_off(hourly(spark, d), BY, ORDER, "y", 40, 3)


@query("on_off_any", "time smooth:i", f"WITH {HOURLY}\n---\nSELECT time, CASE WHEN max(y) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 70 THEN 1 ELSE 0 END AS smooth FROM h")
def on_off_any(spark, d):
    return smooth.on_off(hourly(spark, d), BY, ORDER, "y", 70, 5, "or")


@query("lowess", "sid:l time smooth:d low:d high:d", SQL["lowess"])
def lowess(spark, d):
    return smooth.lowess(supplied(spark, d), BY, "time", "y", 0.1)


@query("kalman", "sid time smooth:d slope:d", SQL["kalman"])
def kalman(spark, d):
    return smooth.kalman(typed(spark, d), BY, "time", "y")


@query("time_step_trend", "time trend:d trend_squared:d t:l", f"WITH {DAILY}\n---\nSELECT time, row_number() OVER ({W}) AS trend, row_number() OVER ({W}) ** 2 AS trend_squared, row_number() OVER ({W}) - 1 AS t FROM d")
def time_step_trend(spark, d):
    return det.time_step(det.trend_terms(daily(spark, d), BY, ORDER, 2), BY, ORDER)


@query("trend_ols", "time trend:d detrended:d", f"WITH {DAILY}, t AS (SELECT *, row_number() OVER ({W}) - 1 AS t FROM d), r AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM t)\n---\nSELECT time, a + b * t AS trend, y - a - b * t AS detrended FROM t, r")
def trend_ols(spark, d):
    return det.linear_trend(daily(spark, d), BY, ORDER, "y")


@query("periodogram", "sid k:i power:d", f"WITH {DAILY}, t AS (SELECT *, row_number() OVER ({W}) - 1 AS t, count(*) OVER () AS m FROM d), r AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM t), e AS (SELECT sid, t, m, y - a - b * t AS e FROM t, r)\n---\nSELECT sid, k, (sum(e * cos(2 * pi() * k * t / m)) ** 2 + sum(e * sin(2 * pi() * k * t / m)) ** 2) / max(m) ** 2 AS power FROM e, (SELECT unnest(range(1, 13)) AS k) GROUP BY sid, k")
def periodogram(spark, d):
    return det.periodogram(daily(spark, d), BY, ORDER, "y", range(1, 13))


@query("decompose", "time trend:d seasonal:d rest:d", f"WITH {HOURLY}, t AS (SELECT *, row_number() OVER ({W}) - 1 AS i, CASE WHEN count(y) OVER a = 24 AND count(y) OVER b = 24 THEN (avg(y) OVER a + avg(y) OVER b) / 2 END AS trend FROM h WINDOW a AS ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), b AS ({W} ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)), p AS (SELECT i % 24 AS p, avg(y - trend) AS s FROM t GROUP BY 1), c AS (SELECT p, s - (SELECT avg(s) FROM p) AS s FROM p)\n---\nSELECT time, trend, c.s AS seasonal, y - trend - c.s AS rest FROM t JOIN c ON i % 24 = c.p")
def decompose(spark, d):
    return det.decompose(hourly(spark, d), BY, ORDER, "y", 24)


@query("kpss", "sid kpss:d", f"WITH {TYPED}, e AS (SELECT sid, time, y - avg(y) OVER (PARTITION BY sid) AS e FROM ty WHERE y IS NOT NULL), s AS (SELECT sid, e, sum(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)\n---\nSELECT sid, sum(s * s) / (count(*) * sum(e * e)) AS kpss FROM s GROUP BY sid")
def kpss(spark, d):
    return det.kpss(drop_missing(typed(spark, d), ["y"]), BY, ORDER, "y")


def _past_future(spark, d):
    h = cal.calendar(hourly(spark, d), "time", ["hour"]).withColumn("x", F.sin(2 * F.pi() * F.col("dt_hour") / 24))
    t = F.lit(CUT).cast("timestamp_ntz")
    return h.filter(F.col("time") < t), h.filter(F.col("time") >= t).drop("y", "n")


@query("usmdo_ols", "time step:i predict_value:d", f"WITH {PAST}, r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p)\n---\nSELECT time, step, a + b * x AS predict_value FROM f, r")
def usmdo_ols(spark, d):
    past, future = _past_future(spark, d)
    return fc.forecast("USMDO", past, future, BY, "y", [], ["x", "absent"], [], 24)


def _recursive_sql(extra: str = "") -> str:
    return f"WITH RECURSIVE {PAST}, l AS (SELECT y, lag(y) OVER (ORDER BY time) AS l FROM p), r AS (SELECT regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM l), z AS (SELECT 0 AS step, arg_max(y, time) AS v FROM p UNION ALL SELECT step + 1, a + b * v FROM z, r WHERE step < 24)\n---\nSELECT f.time, f.step, z.v AS predict_value FROM z JOIN f ON z.step = f.step"


@query("usmr_ols", "time step:i predict_value:d", _recursive_sql())
def usmr_ols(spark, d):
    past, future = _past_future(spark, d)
    return fc.forecast("USMR", past, future, BY, "y", [], [], [1], 24)


@query("usmdr_ols", "time step:i predict_value:d", _recursive_sql())
def usmdr_ols(spark, d):
    past, future = _past_future(spark, d)
    return fc.forecast("USMDR", past, future, BY, "y", [], [], [1], 24)


@query("usmd_ols", "time step:i predict_value:d", f"WITH {PAST}, l AS (SELECT time, y, lag(y) OVER (ORDER BY time) AS l FROM p), s AS (SELECT l, " + ", ".join(f"lead(y, {h}) OVER (ORDER BY time) AS y{h}" for h in range(6)) + " FROM l), v AS (SELECT arg_max(y, time) AS v FROM p), o AS (" + " UNION ALL ".join(f"SELECT {h + 1} AS step, regr_intercept(y{h}, l) + regr_slope(y{h}, l) * (SELECT v FROM v) AS predict_value FROM s WHERE y5 IS NOT NULL" for h in range(6)) + ")\n---\nSELECT f.time, o.step, o.predict_value FROM o JOIN f ON o.step = f.step")
def usmd_ols(spark, d):
    past, future = _past_future(spark, d)
    return fc.forecast("USMD", past, future, BY, "y", [], [], [1], 6)


def _multi(spark, d):
    past, future = _past_future(spark, d)
    return past.withColumn("n", F.col("n").cast("double")), future


@query("msmd_ridge", "time step:i predict_value:d", SQL["msmd_ridge"])
def msmd_ridge(spark, d):
    past, future = _multi(spark, d)
    return fc.forecast("MSMD", past, future, BY, "y", ["n"], ["x"], [1, 2, 24], 24)


@query("msmr_var", "time step:i predict_value:d", SQL["msmr_var"])
def msmr_var(spark, d):
    past, future = _multi(spark, d)
    return fc.forecast("MSMR", past, future, BY, "y", ["n"], ["x"], [1, 2, 24], 24)


@query("msmdr_persist", "time step:i predict_value:d", SQL["msmdr_persist"])
def msmdr_persist(spark, d):
    past, future = _multi(spark, d)
    return fc.forecast("MSMDR", past, future, BY, "y", ["n"], ["x"], [1, 2, 24], 24)


@query("panel_usmr", "sid time step:i predict_value:d", SQL["panel_usmr"])
def panel_usmr(spark, d):
    t = interpolate(typed(spark, d), BY, ORDER, ["y"])
    cut = F.lit(CUT).cast("timestamp_ntz")
    return fc.forecast("USMR", t.filter(F.col("time") < cut), t.filter(F.col("time") >= cut).drop("y"), BY, "y", [], [], [1, 2, 24], 24)


@query("windowed_forecast", "sid:l time predict_value:d", SQL["windowed_forecast"])
def windowed_forecast(spark, d):
    return fc.windowed_forecast(supplied(spark, d), BY, "y", fc.ar_fit, "multiple", 24, 12)


@query("forecast_interval", "time step:i predict_value:d low:d high:d", SQL["forecast_interval"])
def forecast_interval(spark, d):
    h = hourly(spark, d)
    got = bt.scores(bt.naive_predictions(h, bt.window_bounds(h, BY, 336, 24), BY, "y"), ["window"])
    return fc.interval(usmr_ols(spark, d), got)


@query("direct_gbt", "time step:i predict_value:d")
def direct_gbt(spark, d):
    past, future = _past_future(spark, d)
    return fc.direct(past, future, BY, "y", ["y"], ["x"], [1, 24], 3, learners.create("gbt", maxIter=3, maxDepth=3))


def _fit_score(name, **kw):
    def run(spark, d):
        past, _ = _past_future(spark, d)
        wide = windows.lags(past, BY, ORDER, ["y"], [1, 2, 24])
        model = learners.create(name, **kw).fit(wide, ["y_lag_1", "y_lag_2", "y_lag_24", "x"], ["y"])
        return learners.importance_table(spark, model)

    return run


query("gbt_importance", "feature importance:d")(_fit_score("lgb", rounds=5))
query("rf_importance", "feature importance:d")(_fit_score("rf", numTrees=10, maxDepth=5))


@query("ols_fit", "target weight_0:d weight_1:d", f"WITH {PAST}, l AS (SELECT y, lag(y) OVER (ORDER BY time) AS l FROM p)\n---\nSELECT 'y' AS target, regr_intercept(y, l) AS weight_0, regr_slope(y, l) AS weight_1 FROM l")
def ols_fit(spark, d):
    past, _ = _past_future(spark, d)
    m = learners.create("ols").fit(windows.lags(past, BY, ORDER, ["y"], [1]), ["y_lag_1"], ["y"])
    return spark.createDataFrame([("y", float(m.weights[0, 0]), float(m.weights[1, 0]))], "target string, weight_0 double, weight_1 double")


@query("hybrid_trend_gbt", "time y_hybrid:d")
def hybrid_trend_gbt(spark, d):
    t = windows.lags(det.time_step(hourly(spark, d), BY, ORDER), BY, ORDER, ["y"], [1, 24]).na.drop()
    return learners.hybrid(t, ["t"], ["y_lag_1", "y_lag_24"], "y", learners.create("xgb", rounds=3, depth=3))[2]


@query("naive_lag", "time y:d predict_value:d", f"WITH {HOURLY}\n---\nSELECT time, y, lag(y) OVER ({W}) AS predict_value FROM h")
def naive_lag(spark, d):
    return bt.walk_forward(hourly(spark, d), BY, "y", [0.0, 1.0])


@query("split_indices", "sid window:i train_start:i train_end:i test_start:i test_end:i", f"WITH {TYPED}, n AS (SELECT sid, count(*) AS n FROM ty GROUP BY sid), w AS (SELECT sid, n, unnest(range(1, 1 + greatest((n - (336 - 24)) // 24, 0))) AS w FROM n)\n---\nSELECT sid, w AS \"window\", greatest(n - 1 - 24 * (w - 1) - 24 + 1 - (336 - 24), 0) AS train_start, n - 1 - 24 * (w - 1) - 24 + 1 AS train_end, n - 1 - 24 * (w - 1) - 24 + 1 AS test_start, n - 1 - 24 * (w - 1) AS test_end FROM w")
def split_indices(spark, d):
    return bt.window_bounds(typed(spark, d), BY, 336, 24)


@query("ts_folds", "sid window:i train_end:i test_start:i test_end:i", f"WITH {TYPED}, n AS (SELECT sid, count(*) AS n, count(*) // 6 AS k FROM ty GROUP BY sid)\n---\nSELECT sid, w AS \"window\", n - k * (6 - w) AS train_end, n - k * (6 - w) AS test_start, n - k * (6 - w) + k - 1 AS test_end FROM n, (SELECT unnest(range(1, 6)) AS w)")
def ts_folds(spark, d):
    return bt.fold_bounds(typed(spark, d), BY, 5)


BACK = f"WITH {HOURLY}, p AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS m FROM h), w AS (SELECT w, m - 24 * w AS a, m - 24 * w + 23 AS b FROM (SELECT m, unnest(range(1, 1 + greatest((m - (336 - 24)) // 24, 0))) AS w FROM (SELECT max(m) AS m FROM p))), t AS (SELECT w.w, p.time, p.y, p.i - (((p.i - w.a) // {{m}}) + 1) * {{m}} AS src FROM p JOIN w ON p.i BETWEEN w.a AND w.b), e AS (SELECT t.w, t.time, t.y, q.y AS p FROM t JOIN p q ON t.src = q.i)"
SCORE = "avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2"


def _backtest(season):
    def run(spark, d):
        h = hourly(spark, d)
        return bt.scores(bt.naive_predictions(h, bt.window_bounds(h, BY, 336, 24), BY, "y", season), ["window"])

    return run


query("backtest_seasonal_naive", "window:i mse:d mae:d r2:d", BACK.format(m=24) + f"\n---\nSELECT w AS \"window\", {SCORE} FROM e GROUP BY w")(_backtest(24))
query("backtest_period_6", "window:i mse:d mae:d r2:d", BACK.format(m=6) + f"\n---\nSELECT w AS \"window\", {SCORE} FROM e GROUP BY w")(_backtest(6))


@query("backtest_ridge", "window:i mae:d rmse:d r2:d", SQL["backtest_ridge"])
def backtest_ridge(spark, d):
    h = windows.lags(hourly(spark, d), BY, ORDER, ["y"], [24, 25, 48]).na.drop()
    return bt.scores(bt.backtest(h, bt.window_bounds(h, BY, 336, 24), BY, "y", ["y_lag_24", "y_lag_25", "y_lag_48"]), ["window"])


PENALTIES = [0.01, 0.1, 1.0, 10.0, 100.0]


@query("random_search", "trial:i params mae:d", searched([p["penalty"] for p in bt.draw({"penalty": PENALTIES}, 10, 42)]))
def random_search(spark, d):
    h = windows.lags(hourly(spark, d), BY, ORDER, ["y"], [24, 48]).na.drop()

    def make(penalty):
        return lambda x, y, new: bt.ridge_kernel(x, y, new, penalty)

    return bt.random_search(h, bt.fold_bounds(h, BY, 3), BY, "y", ["y_lag_24", "y_lag_48"], {"penalty": PENALTIES}, make)


@query("walk_forward_refit", "sid:l time predict_value:d", SQL["walk_forward_refit"])
def walk_forward_refit(spark, d):
    return bt.walk_forward_refit(supplied(spark, d), BY, "y", 2, 100)


@query("panel_cv_best_model", "sid naive:d seasonal_naive:d best_model", SQL["panel_cv_best_model"])
def panel_cv(spark, d):
    return bt.panel_cv(interpolate(typed(spark, d), BY, ORDER, ["y"]), BY, "y", 24, 2, 24)


PRED = f"p AS (SELECT time, y, lag(y, 1) OVER ({W}) AS p1, lag(y, 24) OVER ({W}) AS p2 FROM h), e AS (SELECT * FROM p WHERE p2 IS NOT NULL)"


def _predictions(spark, d):
    t = windows.lags(hourly(spark, d), BY, ORDER, ["y"], [1, 24]).na.drop()
    return t.select("time", "y", F.col("y_lag_1").alias("p1"), F.col("y_lag_24").alias("p2"))


@query("ensemble_average", "time ensemble:d", f"WITH {HOURLY}, {PRED}\n---\nSELECT time, (p1 + p2) / 2 AS ensemble FROM e")
def ensemble_average(spark, d):
    return ens.average(_predictions(spark, d), ["p1", "p2"])


@query("ensemble_weighted", "time ensemble:d", f"WITH {HOURLY}, {PRED}\n---\nSELECT time, (0.7::DOUBLE * p1 + 0.3::DOUBLE * p2) / (0.7::DOUBLE + 0.3::DOUBLE) AS ensemble FROM e")
def ensemble_weighted(spark, d):
    return ens.weighted(_predictions(spark, d), ["p1", "p2"], [0.7, 0.3])


@query("ensemble_simplex", "name weight:d", f"WITH {HOURLY}, {PRED}, g AS (SELECT sum((p1 - p2) * (y - p2)) / sum((p1 - p2) ** 2) AS w FROM e)\n---\nSELECT 'p1' AS name, least(1.0, greatest(0.0, w)) AS weight FROM g UNION ALL SELECT 'p2', 1 - least(1.0, greatest(0.0, w)) FROM g")
def ensemble_simplex(spark, d):
    w = ens.simplex_weights(_predictions(spark, d), ["p1", "p2"], "y")
    return spark.createDataFrame(list(zip(["p1", "p2"], w, strict=True)), "name string, weight double")


@query("stacking", "time y_hat:d", SQL["stacking"])
def stacking(spark, d):
    p = _predictions(spark, d)
    return ens.stack(p, ["p1", "p2"], "y").predict(p)


@query("oof_stacking", "time train a_oof:d b_oof:d", SQL["oof_stacking"])
def oof_stacking(spark, d):
    p = _predictions(spark, d)
    made = {"a": learners.create("ridge", penalty=1.0), "b": learners.create("ols")}
    past = F.col("time") < F.lit(CUT).cast("timestamp_ntz")
    train, test = ens.out_of_fold(p.filter(past), p.filter(~past), ["p1", "p2"], "y", made, "time", 3)
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


@query("ses", "sid alpha:d level:d mae:d", "WITH RECURSIVE " + HOURLY + ", p AS (SELECT row_number() OVER (ORDER BY time) AS i, y FROM h), a AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS alpha), z AS (SELECT 1::BIGINT AS i, alpha, y AS l, 0.0::DOUBLE AS e FROM p, a WHERE i = 1 UNION ALL SELECT p.i, z.alpha, z.l + z.alpha * (p.y - z.l), z.e + abs(p.y - z.l) FROM z JOIN p ON p.i = z.i + 1)\n---\nSELECT 'all' AS sid, alpha, l AS level, e / (i - 1) AS mae FROM z WHERE i = (SELECT count(*) FROM h)")
def ses(spark, d):
    return sta.ses(hourly(spark, d), BY, "y", [0.1, 0.5, 0.9])


@query("ses_best", "sid alpha:d mae:d", SQL["ses_best"])
def ses_best(spark, d):
    return sta.best_ses(drop_missing(typed(spark, d), ["y"]), BY, "y", [i / 20 for i in range(1, 20)])


@query("holt", "sid level:d trend:d mae:d", "WITH RECURSIVE " + HOURLY + ", p AS (SELECT row_number() OVER (ORDER BY time) AS i, y FROM h), z AS (SELECT 1::BIGINT AS i, y AS l, (SELECT y FROM p WHERE i = 2) - y AS b, 0.0::DOUBLE AS e FROM p WHERE i = 1 UNION ALL SELECT p.i, 0.3::DOUBLE * p.y + 0.7::DOUBLE * (z.l + z.b), 0.1::DOUBLE * (0.3::DOUBLE * p.y + 0.7::DOUBLE * (z.l + z.b) - z.l) + 0.9::DOUBLE * z.b, z.e + abs(p.y - z.l - z.b) FROM z JOIN p ON p.i = z.i + 1)\n---\nSELECT 'all' AS sid, l AS level, b AS trend, e / (i - 1) AS mae FROM z WHERE i = (SELECT count(*) FROM h)")
def holt(spark, d):
    return sta.holt(hourly(spark, d), BY, "y", 0.3, 0.1)


def _panel(*names):
    def run(spark, d):
        return sta.panel_forecast(interpolate(typed(spark, d), BY, ORDER, ["y"]), BY, "y", names, 24, 24)

    return run


for _name in ("croston", "theta", "holt_winters", "ar", "arima", "prophet"):
    query(_name, "sid model step:i predict_value:d low:d high:d", SQL.get(_name))(_panel(_name))

FILLED = f"i AS (SELECT sid, time, y, row_number() OVER (PARTITION BY sid ORDER BY time DESC) AS k FROM ty WHERE y IS NOT NULL), s AS (SELECT unnest(range(1, 25)) AS step)"


@query("historic_average", "sid model step:i predict_value:d", f"WITH {TYPED}, {FILLED}\n---\nSELECT sid, 'historic_average' AS model, step, avg(y) AS predict_value FROM i, s GROUP BY sid, step")
def historic_average(spark, d):
    return sta.panel_forecast(drop_missing(typed(spark, d), ["y"]), BY, "y", ["historic_average"], 24, 24)


@query("seasonal_naive", "sid model step:i predict_value:d", f"WITH {TYPED}, {FILLED}\n---\nSELECT i.sid, 'seasonal_naive' AS model, s.step, i.y AS predict_value FROM i JOIN s ON i.k = 25 - s.step")
def seasonal_naive(spark, d):
    return sta.panel_forecast(drop_missing(typed(spark, d), ["y"]), BY, "y", ["seasonal_naive"], 24, 24)


@query("linear_var", "sid qty_next_1:d rev_next_1:d", SQL["linear_var"])
def linear_var(spark, d):
    return sta.linear_var(shipped(spark, d), BY, ["qty", "rev"], [0, 1, 2], 1)[1]


@query("bayes_var", "sid column step:i mean:d low:d high:d")
def bayes_var(spark, d):
    return sta.bayes_var(shipped(spark, d), BY, ["qty", "rev"])


@query("factor_impute", "panel:i sid:l time imputed:d")
def factor_impute(spark, d):
    """The suppliers of a nation are a panel: their months, with gaps where nothing was shipped."""
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time")
    got = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), month).agg(F.avg("l_quantity").alias("y"))
    panels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("panel"))
    months = got.select("time").distinct()
    return sta.factor_impute(panels.crossJoin(F.broadcast(months)).join(got, ["sid", "time"], "left"), ["panel", "sid"], "y")


def _stream(spark, d, make, mode):
    """Run a file stream over the events to its end."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return streams.run_to_end(make(source), "events", mode, spark)


@query("stream_resample", "ts event_type y:d n:l", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type, avg(value) AS y, count(*) AS n FROM events GROUP BY 1, 2")
def stream_resample(spark, d):
    got = _stream(spark, d, lambda s: streams.resample(s, "ts", "1 hour", "value", ("event_type",)), "complete")
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_window_alarm", "ts mean:d alarm", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS mean, avg(value) < 30 OR avg(value) > 60 OR var_pop(value) > 2700 AS alarm FROM events GROUP BY 1")
def stream_window_alarm(spark, d):
    got = _stream(spark, d, lambda s: streams.window_alarm(s, "ts", "value", 30, 60, 2700), "complete")
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_sessions", "user_id:l n:l", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS g, event_id FROM events), s AS (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)\n---\nSELECT user_id, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark, d):
    return _stream(spark, d, lambda s: streams.sessions(s, "ts", "user_id", "2 hours"), "complete")


@query("stream_point_check", "event_type ts value:d smooth:d is_anomaly")
def stream_point_check(spark, d):
    return _stream(spark, d, lambda s: streams.point_check(s, "event_type", "ts", "value"), "append")


def _run(spark, d, method):
    from chronoloom.config import ForecastConfig
    from chronoloom.plans.run import run

    events = table(spark, d, "events").select(F.col("event_type").alias("sid"), F.window("ts", "1 hour").getField("start").alias("time"), "value")
    series = events.groupBy("sid", "time").agg(F.avg("value").alias("load"), F.count(F.lit(1)).cast("double").alias("n"))
    cfg = ForecastConfig("load", (1, 2, 24), "h", method=method, numeric=("n",), window_days=14, datetime_features=("hour", "weekday"))
    return run(cfg, {"target_series": series}, BY)


@query("run_scores", "sid window mae:d rmse:d r2:d", SQL["run_scores"])
def run_scores(spark, d):
    return _run(spark, d, "USMR").scores


@query("run_scores_msmr", "sid window mae:d rmse:d r2:d", SQL["run_scores_msmr"])
def run_scores_msmr(spark, d):
    return _run(spark, d, "MSMR").scores


@query("run_scores_usmd", "sid window mae:d rmse:d r2:d", SQL["run_scores_usmd"])
def run_scores_usmd(spark, d):
    return _run(spark, d, "USMD").scores


@query("run_forecast", "sid time step:i predict_value:d", SQL["run_forecast"])
def run_forecast(spark, d):
    return _run(spark, d, "MSMR").forecast


@query("suod_average", "sid time average:d maximum:d")
def suod_average(spark, d):
    s = shipped(spark, d)
    lof = ad.density(s, BY, "time", "rev", "lof", 20).withColumnRenamed("score", "lof")
    forest = ad.isolation_forest(lof, BY, ["qty", "rev"]).drop("is_anomaly").withColumnRenamed("score", "forest")
    near = ad.knn_distance(s, BY, "time", "rev", 5)
    return ad.combine_scores(forest.join(near, ["sid", "time"]), ["lof", "forest", "knn_mean"])

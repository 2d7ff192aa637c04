"""Window features, aggregates, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import aggregates as agg
from chronoloom.operators import joins, windows
from chronoloom.operators.align import over
from chronoloom.operators.chunks import chunked, own_rows
from chronoloom.plans import backtest as bt
from chronoloom.plans import deterministic as det
from chronoloom.queries.base import BY, DAILY, HOURLY, ORDER, SHIPPED, TYPED, W, daily, hourly, query, shipped, table, typed
from chronoloom.queries.fitted_sql import SQL


@query("lags_uni", "time y_lag_1:d y_lag_2:d y_lag_24:d", f"WITH {HOURLY}\n---\nSELECT time, lag(y, 1) OVER ({W}) AS y_lag_1, lag(y, 2) OVER ({W}) AS y_lag_2, lag(y, 24) OVER ({W}) AS y_lag_24 FROM h")
def lags_uni(spark, d):
    return windows.lags(hourly(spark, d), BY, ORDER, ["y"], [1, 2, 24])


@query("lags_multi", "sid time qty_lag_1:d qty_lag_7:d rev_lag_1:d rev_lag_7:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, lag(qty, 1) OVER ({W}) AS qty_lag_1, lag(qty, 7) OVER ({W}) AS qty_lag_7, lag(rev, 1) OVER ({W}) AS rev_lag_1, lag(rev, 7) OVER ({W}) AS rev_lag_7 FROM s")
def lags_multi(spark, d):
    return windows.lags(shipped(spark, d), BY, ORDER, ["qty", "rev", "absent"], [1, 7])


@query("targets_direct", "time y_shift_0:d y_shift_1:d y_shift_2:d", f"WITH {HOURLY}\n---\nSELECT time, y AS y_shift_0, lead(y, 1) OVER ({W}) AS y_shift_1, lead(y, 2) OVER ({W}) AS y_shift_2 FROM h")
def targets_direct(spark, d):
    return windows.targets(hourly(spark, d), BY, ORDER, "y", 3)


@query("targets_array", "time total:d", f"WITH {HOURLY}\n---\nSELECT time, CASE WHEN count(*) OVER f = 24 THEN sum(y) OVER f END AS total FROM h WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)")
def targets_array(spark, d):
    t = windows.target_array(hourly(spark, d), BY, ORDER, "y", 24)
    return t.select("time", F.aggregate("targets", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _roll(names, sql):
    spec = "sid time " + " ".join(f"{n}:d" for n in names)
    f = f"{W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"
    return spec, f"WITH {TYPED}\n---\nSELECT sid, time, {sql} FROM ty WINDOW f AS ({f})"


SKEW = "CASE WHEN count(y) OVER f >= 3 THEN skewness(y) OVER f END"
KURT = "CASE WHEN count(y) OVER f >= 4 THEN kurtosis(y) OVER f END"


@query("roll_mean_std", *_roll(["y_rolling_mean_7", "y_rolling_std_7"], "avg(y) OVER f AS y_rolling_mean_7, stddev_samp(y) OVER f AS y_rolling_std_7"))
def roll_mean_std(spark, d):
    return windows.rolling(typed(spark, d), BY, ORDER, ["y"], [7], ["mean", "std"])


@query("roll_min_max", *_roll(["y_rolling_min_7", "y_rolling_max_7"], "min(y) OVER f AS y_rolling_min_7, max(y) OVER f AS y_rolling_max_7"))
def roll_min_max(spark, d):
    return windows.rolling(typed(spark, d), BY, ORDER, ["y"], [7], ["min", "max"])


@query("roll_median", *_roll(["y_rolling_median_7"], "median(y) OVER f AS y_rolling_median_7"))
def roll_median(spark, d):
    return windows.rolling(typed(spark, d), BY, ORDER, ["y"], [7], ["median"])


@query("roll_skew_kurt", *_roll(["y_rolling_skew_7", "y_rolling_kurt_7"], f"{SKEW} AS y_rolling_skew_7, {KURT} AS y_rolling_kurt_7"))
def roll_skew_kurt(spark, d):
    return windows.rolling(typed(spark, d), BY, ORDER, ["y"], [7], ["skew", "kurt"])


@query("roll_all_stats", "time y_rolling_mean_24:d y_rolling_std_24:d y_rolling_min_24:d y_rolling_max_24:d y_rolling_median_24:d", f"WITH {HOURLY}\n---\nSELECT time, avg(y) OVER f AS y_rolling_mean_24, stddev_samp(y) OVER f AS y_rolling_std_24, min(y) OVER f AS y_rolling_min_24, max(y) OVER f AS y_rolling_max_24, median(y) OVER f AS y_rolling_median_24 FROM h WINDOW f AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def roll_all_stats(spark, d):
    return windows.rolling(hourly(spark, d), BY, ORDER, ["y"], [24])


@query("roll_wide_mean", "time y_rolling_mean_168:d", f"WITH {HOURLY}\n---\nSELECT time, avg(y) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS y_rolling_mean_168 FROM h")
def roll_wide_mean(spark, d):
    return windows.wide_mean(hourly(spark, d), BY, ORDER, "y", 168)


@query("expanding_stats", "sid time y_expanding_mean:d y_expanding_std:d y_expanding_min:d y_expanding_max:d", f"WITH {TYPED}\n---\nSELECT sid, time, avg(y) OVER f AS y_expanding_mean, stddev_samp(y) OVER f AS y_expanding_std, min(y) OVER f AS y_expanding_min, max(y) OVER f AS y_expanding_max FROM (SELECT sid, time, y * 0.6180339887::DOUBLE AS y FROM ty) WINDOW f AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def expanding_stats(spark, d):
    return windows.expanding(typed(spark, d).withColumn("y", F.col("y") * 0.6180339887), BY, ORDER, ["y"])


@query("roll_chunked", "sid time y_lag_24:d y_rolling_mean_24:d", f"WITH {TYPED}\n---\nSELECT sid, time, lag(y, 24) OVER ({W}) AS y_lag_24, avg(y) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS y_rolling_mean_24 FROM ty")
def roll_chunked(spark, d):
    cut = chunked(typed(spark, d), "time", 7 * 86400, 25 * 3600)  # on a regular grid 25 hours hold 24 rows before any row
    t = windows.lags(cut, [*BY, "chunk"], ORDER, ["y"], [24])
    return own_rows(windows.rolling(t, [*BY, "chunk"], ORDER, ["y"], [24], ["mean"]))


@query("diff", "time y_diff_1:d y_diff_7:d y_diff_24:d", f"WITH {HOURLY}\n---\nSELECT time, y - lag(y, 1) OVER ({W}) AS y_diff_1, y - lag(y, 7) OVER ({W}) AS y_diff_7, y - lag(y, 24) OVER ({W}) AS y_diff_24 FROM h")
def diff(spark, d):
    return windows.diffs(hourly(spark, d), BY, ORDER, ["y"])


@query("pct_change", "sid time y_pct_change_1:d y_pct_change_7:d", f"WITH {TYPED}, f AS (SELECT sid, time, last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM ty)\n---\nSELECT sid, time, y / nullif(lag(y, 1) OVER ({W}), 0) - 1 AS y_pct_change_1, y / nullif(lag(y, 7) OVER ({W}), 0) - 1 AS y_pct_change_7 FROM f")
def pct_change(spark, d):
    return windows.pct_changes(typed(spark, d), BY, ORDER, ["y"])


@query("time_since_events", "time y_time_since_peak:l y_time_since_trough:l", f"WITH {HOURLY}, a AS (SELECT *, row_number() OVER ({W}) - 1 AS p, lag(y) OVER ({W}) AS a, lead(y) OVER ({W}) AS b FROM h)\n---\nSELECT time, coalesce(p - last_value(CASE WHEN a < y AND y > b THEN p END IGNORE NULLS) OVER f, p) AS y_time_since_peak, coalesce(p - last_value(CASE WHEN a > y AND y < b THEN p END IGNORE NULLS) OVER f, p) AS y_time_since_trough FROM a WINDOW f AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def time_since_events(spark, d):
    return windows.time_since(hourly(spark, d), BY, ORDER, "y")


@query("returns_vol", "sid time ret_5:d vol_5:d volume_5:d", f"WITH {SHIPPED}, r AS (SELECT *, rev / lag(rev) OVER ({W}) - 1 AS r FROM s)\n---\nSELECT sid, time, rev / lag(rev, 5) OVER ({W}) - 1 AS ret_5, CASE WHEN count(r) OVER f = 5 THEN stddev_samp(r) OVER f END AS vol_5, CASE WHEN count(qty) OVER g = 10 THEN avg(qty) OVER f / avg(qty) OVER g END AS volume_5 FROM r WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def returns_vol(spark, d):
    return windows.returns_and_volatility(shipped(spark, d), BY, ORDER, "rev", "qty", [5])


OHLC = "o AS (SELECT o_orderstatus AS sid, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time, arg_max(o_totalprice, o_orderkey) AS close, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, avg(o_totalprice) AS sprice, sum(o_totalprice) AS volume, count(*) AS interest FROM orders GROUP BY 1, 2)"


def _ohlc(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time")
    p = "o_totalprice"
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("sid"), month).agg(F.max_by(p, "o_orderkey").alias("close"), F.min_by(p, "o_orderkey").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.avg(p).alias("sprice"), F.sum(p).alias("volume"), F.count(F.lit(1)).alias("interest"))


@query("breakout_flags", "sid time break_high:i break_low:i", f"WITH {OHLC}\n---\nSELECT sid, time, CASE WHEN close > last_value(high IGNORE NULLS) OVER f THEN 1 ELSE 0 END AS break_high, CASE WHEN close < last_value(low IGNORE NULLS) OVER f THEN 1 ELSE 0 END AS break_low FROM o WINDOW f AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def breakout_flags(spark, d):
    return windows.breakouts(_ohlc(spark, d), BY, ORDER, "close", "high", "low")


@query("ohlc_spreads", "sid time open_close:d low_close:d low_high:d open_gap:d settle_change:d premium:d", f"WITH {OHLC}\n---\nSELECT sid, time, open / close - 1 AS open_close, low / close - 1 AS low_close, low / high - 1 AS low_high, open / lag(close) OVER ({W}) - 1 AS open_gap, sprice / lag(sprice) OVER ({W}) - 1 AS settle_change, close / sprice - 1 AS premium FROM o")
def ohlc_spreads(spark, d):
    return windows.price_spreads(_ohlc(spark, d), BY, ORDER)


@query("forward_log_returns", "sid time label_1:d label_2:d label_3:d label_4:d", f"WITH {OHLC}\n---\nSELECT sid, time, " + ", ".join(f"-ln(lead(close, {1 + k}) OVER ({W}) / lead(close, 1) OVER ({W})) AS label_{k}" for k in (1, 2, 3, 4)) + " FROM o")
def forward_log_returns(spark, d):
    return windows.forward_log_returns(_ohlc(spark, d), BY, ORDER, "close")


@query("centered_ma", "time trend:d", f"WITH {DAILY}\n---\nSELECT time, CASE WHEN count(y) OVER f >= 183 THEN avg(y) OVER f END AS trend FROM d WINDOW f AS ({W} ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)")
def centered_ma(spark, d):
    return windows.centered_mean(daily(spark, d), BY, ORDER, "y", 365, 183)


@query("make_lags_steps", "time y_lag_2:d y_lag_3:d y_step_1:d y_step_2:d", f"WITH {DAILY}\n---\nSELECT time, lag(y, 2) OVER ({W}) AS y_lag_2, lag(y, 3) OVER ({W}) AS y_lag_3, y AS y_step_1, lead(y) OVER ({W}) AS y_step_2 FROM d")
def make_lags_steps(spark, d):
    return windows.make_steps(windows.make_lags(daily(spark, d), BY, ORDER, "y", 2, 2), BY, ORDER, "y", 2)


@query("tde", "sid time qty(t-2):d qty(t-1):d qty(t):d qty(t+1):d", f"WITH {SHIPPED}\n---\nSELECT * FROM (SELECT sid, time, lag(qty, 2) OVER ({W}) AS \"qty(t-2)\", lag(qty) OVER ({W}) AS \"qty(t-1)\", qty AS \"qty(t)\", lead(qty) OVER ({W}) AS \"qty(t+1)\" FROM s) WHERE \"qty(t-2)\" IS NOT NULL AND \"qty(t+1)\" IS NOT NULL")
def tde(spark, d):
    return windows.embed(shipped(spark, d), BY, ORDER, ["qty"], 2, 2)


@query("chained_shifts", "sid time goal:d a1:d a2:d a3:d a4:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, qty AS goal, lag(qty, 1) OVER ({W}) AS a1, lag(qty, 2) OVER ({W}) AS a2, lag(rev, 1) OVER ({W}) AS a3, lag(rev, 2) OVER ({W}) AS a4 FROM s")
def chained_shifts(spark, d):
    return windows.chained_shifts(shipped(spark, d), BY, ORDER, ["qty", "rev"], 2)


@query("lag_shift_demo", "time y_lag_1:d y_lag_7:d shift_0:d shift_1:d", f"WITH {HOURLY}\n---\nSELECT time, lag(y, 1) OVER ({W}) AS y_lag_1, lag(y, 7) OVER ({W}) AS y_lag_7, y AS shift_0, lead(y) OVER ({W}) AS shift_1 FROM h")
def lag_shift_demo(spark, d):
    t = windows.lags(hourly(spark, d), BY, ORDER, ["y"], range(1, 8))
    return windows.targets(t, BY, ORDER, "y", 2).withColumnsRenamed({"y_shift_0": "shift_0", "y_shift_1": "shift_1"})


ACF = f"WITH {HOURLY}, m AS (SELECT *, avg(y) OVER () AS m FROM h), l AS (SELECT y, m, k, lag(y, k) OVER (PARTITION BY k ORDER BY time) AS l FROM m, (SELECT unnest(range(1, 7)) AS k))\n---\nSELECT 'all' AS sid, k AS lag, corr(y, l) AS corr, sum((y - m) * (l - m)) / sum((y - m) * (y - m)) AS acf FROM l GROUP BY k"


@query("acf", "sid lag:i corr:d acf:d", ACF)
def acf(spark, d):
    return windows.lag_correlation(hourly(spark, d), BY, ORDER, "y", range(1, 7))


@query("pacf", "lag:i pacf:d", SQL["pacf"])
def pacf(spark, d):
    a = windows.lag_correlation(hourly(spark, d), BY, ORDER, "y", range(1, 7)).orderBy("lag").collect()  # six rows
    return spark.createDataFrame([(i, v) for i, v in enumerate(det.pacf([r.acf for r in a]), 1)], "lag int, pacf double")


@query("seasonal_diff", "time sdiff:d yoy:d log_diff:d", f"WITH {DAILY}\n---\nSELECT time, y - lag(y, 4) OVER ({W}) AS sdiff, y / lag(y, 12) OVER ({W}) - 1 AS yoy, ln(y) - ln(lag(y) OVER ({W})) AS log_diff FROM d")
def seasonal_diff(spark, d):
    return windows.seasonal_changes(daily(spark, d), BY, ORDER, "y", 4, 12)


@query("resample_hourly", "sid ts y:d n:l", "SELECT event_type AS sid, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS y, count(*) AS n FROM events GROUP BY 1, 2")
def resample_hourly(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "sid")
    return agg.resample(e, BY, "ts", "1 hour", y=F.avg("value"), n=F.count(F.lit(1)))


@query("resample_month_last", "o_orderstatus month y_mean:d y_last:d", "SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, avg(y) AS y_mean, arg_max(y, (o_orderdate, o_orderkey)) AS y_last FROM (SELECT *, o_totalprice / 1000 AS y FROM orders) GROUP BY 1, 2")
def resample_month_last(spark, d):
    return agg.resample_month(table(spark, d, "orders").withColumn("y", F.col("o_totalprice") / 1000), ["o_orderstatus"], "o_orderdate", "y", ["o_orderkey"])


@query("profile_validate", "column n_missing:l n_inf:l low:d high:d n_unique:l", f"WITH {TYPED}\n---\nSELECT 'y' AS \"column\", sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS n_missing, 0 AS n_inf, min(y) AS low, max(y) AS high, count(DISTINCT y) AS n_unique FROM ty UNION ALL SELECT 'k', 0, 0, 1, 1, 1")
def profile_validate(spark, d):
    return agg.profile(typed(spark, d).withColumn("k", F.lit(1.0)), ["y", "k"])


@query("quantiles", "l_returnflag q:d value:d", " UNION ALL ".join(f"SELECT l_returnflag, {q} AS q, quantile_cont(l_extendedprice, {q}) AS value FROM lineitem GROUP BY 1" for q in (0.25, 0.5, 0.75)))
def quantiles(spark, d):
    return agg.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])


@query("value_counts", "o_custkey:l n:l", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3")
def value_counts(spark, d):
    return agg.value_counts(table(spark, d, "orders"), ["o_custkey"], 3)


@query("corr_matrix", "a b corr:d", f"WITH {SHIPPED}\n---\nSELECT 'qty' AS a, 'rev' AS b, corr(qty, rev) AS corr FROM s UNION ALL SELECT 'qty', 'disc', corr(qty, disc) FROM s UNION ALL SELECT 'rev', 'disc', corr(rev, disc) FROM s")
def corr_matrix(spark, d):
    return agg.pearson(shipped(spark, d), ["qty", "rev", "disc"])


RANK = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"


@query("spearman", "sid rho:d", f"WITH {SHIPPED}, r AS (SELECT sid, {RANK.format(by='sid', c='qty')} AS a, {RANK.format(by='sid', c='rev')} AS b FROM s)\n---\nSELECT sid, corr(a, b) AS rho FROM r GROUP BY sid")
def spearman(spark, d):
    return agg.spearman(shipped(spark, d), BY, "qty", "rev")


@query("kendall", "sid tau:d", f"WITH {SHIPPED}\n---\nSELECT p.sid, sum(sign(q.qty - p.qty) * sign(q.rev - p.rev)) / sqrt(sum(sign(q.qty - p.qty) ** 2) * sum(sign(q.rev - p.rev) ** 2)) AS tau FROM s p JOIN s q ON p.sid = q.sid AND p.time < q.time GROUP BY 1")
def kendall(spark, d):
    return agg.kendall(shipped(spark, d), BY, "qty", "rev")


@query("average_rank", "sid time r:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, {RANK.format(by='sid', c='qty')} AS r FROM s")
def average_rank(spark, d):
    return agg.average_rank(shipped(spark, d), BY, "qty", "r")


@query("position_rank", "sid time r:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, (row_number() OVER (PARTITION BY sid ORDER BY qty, time) - 1) / 424.0::DOUBLE AS r FROM s")
def position_rank(spark, d):
    return agg.position_rank(shipped(spark, d), BY, ["qty", "time"], "r", 424)


@query("f_regression", "feature f:d", f"WITH {SHIPPED}, r AS (SELECT 'qty' AS feature, corr(qty, disc) AS r, count(*) AS n FROM s UNION ALL SELECT 'rev', corr(rev, disc), count(*) FROM s)\n---\nSELECT feature, r * r / (1 - r * r) * (n - 2) AS f FROM r")
def f_regression(spark, d):
    return agg.f_regression(shipped(spark, d), ["qty", "rev"], "disc")


NAIVE = f"p AS (SELECT sid, time, y, lag(y) OVER ({W}) AS p FROM ty), e AS (SELECT * FROM p WHERE y IS NOT NULL AND p IS NOT NULL)"


def _naive(spark, d):
    t = typed(spark, d)
    return t.select("sid", "time", "y", F.lag("y").over(over(BY, ORDER)).alias("p")).na.drop()


@query("metrics_all", "sid r2:d mse:d rmse:d mae:d mape:d mape_accuracy:d", f"WITH {TYPED}, {NAIVE}\n---\nSELECT sid, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, avg(abs((y - p) / CASE WHEN y = 0 THEN 0.01 ELSE y END)) AS mape, 1 - avg(abs((y - p) / CASE WHEN y = 0 THEN 0.01 ELSE y END)) AS mape_accuracy FROM e GROUP BY sid")
def metrics_all(spark, d):
    return bt.scores(_naive(spark, d), BY, "y", "p")


@query("metrics_variants", "sid mape_nonzero:d mape_mean:d smape:d mean_error:d", f"WITH {TYPED}, {NAIVE}\n---\nSELECT sid, avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS mape_nonzero, avg(abs(y - p)) / abs(avg(y)) AS mape_mean, avg(2 * abs(y - p) / nullif(abs(y) + abs(p), 0)) AS smape, avg(y - p) AS mean_error FROM e GROUP BY sid")
def metrics_variants(spark, d):
    return _naive(spark, d).groupBy("sid").agg(*[m.alias(n) for n, m in agg.metric_variants("y", "p").items()])


@query("huber", "sid huber:d", f"WITH {TYPED}, {NAIVE}\n---\nSELECT sid, avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) ** 2 ELSE abs(y - p) - 0.5 END) AS huber FROM e GROUP BY sid")
def huber(spark, d):
    return _naive(spark, d).groupBy("sid").agg(agg.huber("y", "p").alias("huber"))


@query("score_mean_row", "sid mae:d mse:d", f"WITH {TYPED}, {NAIVE}, m AS (SELECT sid, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse FROM e GROUP BY sid)\n---\nSELECT * FROM m UNION ALL SELECT 'mean', avg(mae), avg(mse) FROM m")
def score_mean_row(spark, d):
    return agg.with_mean_row(bt.scores(_naive(spark, d), BY, "y", "p"), "sid", ["mae", "mse"])


@query("rank_ic_sharpe", "days:l mean_ic:d sharpe:d", f"WITH {HOURLY}, e AS (SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS day, y, lag(y) OVER ({W}) AS p FROM h), f AS (SELECT * FROM e WHERE p IS NOT NULL), r AS (SELECT day, {RANK.format(by='day', c='y')} AS a, {RANK.format(by='day', c='p')} AS b FROM f), c AS (SELECT day, corr(a, b) AS rho FROM r GROUP BY day)\n---\nSELECT count(rho) AS days, avg(rho) AS mean_ic, avg(rho) / stddev_pop(rho) AS sharpe FROM c")
def rank_ic_sharpe(spark, d):
    h = hourly(spark, d)
    p = h.select(F.window("time", "1 day").getField("start").alias("day"), "y", F.lag("y").over(over(BY, ORDER)).alias("p")).na.drop()
    return agg.rank_sharpe(p, "day", "y", "p")


@query("kl_divergence", "kl:d", f"WITH {SHIPPED}\n---\nSELECT sum((qty / tq) * ln((qty / tq) / (rev / tr))) AS kl FROM (SELECT qty, rev, sum(qty) OVER () AS tq, sum(rev) OVER () AS tr FROM s)")
def kl_divergence(spark, d):
    return agg.kl_divergence(shipped(spark, d), "qty", "rev")


@query("durbin_watson", "sid dw:d", f"WITH {TYPED}, {NAIVE}, r AS (SELECT sid, time, y - p AS e FROM e)\n---\nSELECT sid, sum(x * x) / sum(e * e) AS dw FROM (SELECT sid, e, e - lag(e) OVER ({W}) AS x FROM r) GROUP BY sid")
def durbin_watson(spark, d):
    return agg.durbin_watson(_naive(spark, d).withColumn("e", F.col("y") - F.col("p")), BY, ORDER, "e")


@query("ljung_box", "sid q:d", ACF.replace("\n---\n", ", a AS (") + ")\n---\nSELECT sid, (SELECT count(*) FROM h) * ((SELECT count(*) FROM h) + 2) * sum(acf * acf / ((SELECT count(*) FROM h) - lag)) AS q FROM a GROUP BY sid")
def ljung_box(spark, d):
    h = hourly(spark, d)
    return agg.ljung_box(windows.lag_correlation(h, BY, ORDER, "y", range(1, 7)), BY, h.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))


@query("jarque_bera", "sid jb:d", f"WITH {TYPED}, m AS (SELECT sid, y, avg(y) OVER (PARTITION BY sid) AS m FROM ty WHERE y IS NOT NULL), k AS (SELECT sid, count(*) AS n, avg((y - m) ** 2) AS m2, avg((y - m) ** 3) AS m3, avg((y - m) ** 4) AS m4 FROM m GROUP BY sid)\n---\nSELECT sid, n / 6.0::DOUBLE * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) AS jb FROM k")
def jarque_bera(spark, d):
    return agg.jarque_bera(typed(spark, d), BY, "y")


@query("row_stats", "sid time lag_mean:d lag_std:d", f"WITH {SHIPPED}, l AS (SELECT sid, time, [x for x in [lag(qty, 1) OVER ({W}), lag(qty, 2) OVER ({W}), lag(qty, 3) OVER ({W})] if x IS NOT NULL] AS v FROM s)\n---\nSELECT sid, time, list_avg(v) AS lag_mean, list_stddev_pop(v) AS lag_std FROM l")
def row_stats(spark, d):
    t = windows.lags(shipped(spark, d), BY, ORDER, ["qty"], [1, 2, 3])
    return agg.row_stats(t, ["qty_lag_1", "qty_lag_2", "qty_lag_3"], "lag")


KERNEL = " + ".join(f"exp(-d / (w * pow(2.0::DOUBLE, {i - 2})))" for i in range(5))


@query("mmd_linear", "pairs:l k_source:d k_target:d k_between:d mmd:d", f"""
WITH n AS (SELECT embedding::DOUBLE[] AS v, label % 2 AS part, vec_id FROM embeddings WHERE label % 2 IN (0, 1)),
a AS (SELECT v, row_number() OVER (ORDER BY vec_id % 64, vec_id) - 1 AS i, count(*) OVER () AS n FROM n WHERE part = 0),
b AS (SELECT v, row_number() OVER (ORDER BY vec_id % 64, vec_id) - 1 AS i, count(*) OVER () AS n FROM n WHERE part = 1),
g AS (SELECT i FROM a UNION SELECT i FROM b),
w AS (SELECT avg(list_distance(p.v, q.v) ** 2) AS w FROM n p JOIN n q ON p.vec_id <> q.vec_id),
d AS (SELECT 'x' AS kind, list_distance(p.v, q.v) ** 2 AS d FROM a p JOIN a q ON q.i = (p.i + 1) % p.n
UNION ALL SELECT 'y', list_distance(p.v, q.v) ** 2 FROM b p JOIN b q ON q.i = (p.i + 1) % p.n
UNION ALL SELECT 'xy', list_distance(a.v, b.v) ** 2 FROM g JOIN a ON a.i = g.i % a.n JOIN b ON b.i = (g.i + 1) % b.n
UNION ALL SELECT 'xy', list_distance(a.v, b.v) ** 2 FROM g JOIN a ON a.i = (g.i + 1) % a.n JOIN b ON b.i = g.i % b.n),
m AS (SELECT avg(k) FILTER (kind = 'x') AS x, avg(k) FILTER (kind = 'y') AS y, avg(k) FILTER (kind = 'xy') AS xy FROM (SELECT kind, {KERNEL} AS k FROM d, w))
---
SELECT (SELECT count(*) FROM g) AS pairs, x AS k_source, y AS k_target, xy AS k_between, x + y - 2 * xy AS mmd FROM m""")
def mmd_linear(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") % 2).alias("part"))
    return joins.kernel_sums(e.filter("part = 0"), e.filter("part = 1"), "vec_id", "v")

"""Sources, alignment, filters, joins, reshapes, scalar functions, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import calendar as cal
from chronoloom.functions import weather as wx
from chronoloom.operators import align, encode, joins, reshape
from chronoloom.operators import aggregates as agg
from chronoloom.plans import deterministic as det
from chronoloom.queries.base import BY, DAILY, HOURLY, ORDER, SHIPPED, TYPED, W, daily, hourly, query, shipped, table, typed
from chronoloom.sources import generators as gen

MONTHS = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


@query("grid_left_join", "sid time y:d", f"WITH {TYPED}\n---\nSELECT sid, time, y FROM ty")
def grid_left_join(spark, d):
    return typed(spark, d)


@query("date_range_grid", "time", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02' - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS time")
def date_range_grid(spark, d):
    return align.time_grid(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "5 minutes")


@query("dedup_keep_last", "user_id:l hour event_id:l value:d", "SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) = 1")
def dedup_keep_last(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.window("ts", "1 hour").getField("start"))
    return align.keep_last(e, ["user_id", "hour"], ["event_id"])


@query("target_series", "time y:d n:d status", f"WITH {HOURLY}, x AS (SELECT CAST(date_trunc('hour', o_orderdate) AS TIMESTAMP) AS t FROM orders)\n---\nSELECT g.time, h.y, CAST(h.n AS DOUBLE) AS n, h.sid AS status FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS time) g LEFT JOIN h ON g.time = h.time")
def target_series(spark, d):
    grid = align.time_grid(spark, *MONTHS, "1 hour")
    got, _ = align.target_series(grid, hourly(spark, d).withColumnsRenamed({"y": "value", "sid": "status"}), "time", "value", ["n", "value"], ["status"])
    return got


@query("numeric_coercion", "user_id:l x:d s", "SELECT user_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x, CAST(user_id AS VARCHAR) AS s FROM events")
def numeric_coercion(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "view", "bad").otherwise(F.col("user_id").cast("string")).alias("x"), F.col("user_id").alias("s"))
    return align.to_text(align.to_number(e, ["x"]), ["s"])


@query("prune_rename_reorder", "o_orderkey:l status price:d", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders")
def prune_rename_reorder(spark, d):
    o = align.keep_existing(table(spark, d, "orders"), ["o_totalprice", "o_orderkey", "absent", "o_orderstatus", "o_comment"])
    return reshape.move_last(align.drop_existing(o.withColumnsRenamed({"o_totalprice": "price", "o_orderstatus": "status"}), ["o_comment", "absent"]), "price")


@query("predictor_target_split", "sid time y:d y_lag:d", f"WITH {TYPED}\n---\nSELECT * FROM (SELECT sid, time, y, lag(y) OVER ({W}) AS y_lag FROM ty) WHERE y IS NOT NULL AND y_lag IS NOT NULL")
def predictor_target_split(spark, d):
    t = typed(spark, d).withColumn("y_lag", F.lag("y").over(align.over(BY, ORDER)))
    return align.predictors_and_target(t, ["sid", "time", "y_lag"], ["y"])[0]


@query("dropna_subset", "sid n:l", f"WITH {TYPED}\n---\nSELECT sid, count(*) AS n FROM ty WHERE y IS NOT NULL GROUP BY sid")
def dropna_subset(spark, d):
    return agg.value_counts(align.drop_missing(typed(spark, d), ["y"]), ["sid"])


@query("range_slice", "event_id:l ts", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def range_slice(spark, d):
    return align.between(table(spark, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-10 00:00:00")


@query("id_membership", "o_orderkey:l", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def id_membership(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.members(table(spark, d, "orders"), rich, ["o_custkey"])


@query("holiday_anti_join", "time n:l", f"WITH {DAILY}\n---\nSELECT time, n FROM d WHERE NOT (month(time) = 1 AND day(time) = 1)")
def holiday_anti_join(spark, d):
    days = daily(spark, d)
    holidays = days.filter("month(time) = 1 AND day(time) = 1").select("time")
    return joins.members(days, holidays, ["time"], inside=False)


@query("split_ratio", "sid part n:l last", f"WITH {TYPED}\n---\nSELECT sid, part, count(*) AS n, max(time) AS last FROM (SELECT sid, time, CASE WHEN row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY sid) * 0.8) THEN 'train' ELSE 'test' END AS part FROM ty) GROUP BY 1, 2")
def split_ratio(spark, d):
    return align.split_ratio(typed(spark, d), BY, ORDER, 0.8).groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last"))


@query("split_tail_and_date", "sid tail date n:l", f"WITH {TYPED}\n---\nSELECT sid, tail, date, count(*) AS n FROM (SELECT sid, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY time DESC) <= 48 THEN 'test' ELSE 'train' END AS tail, CASE WHEN time < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS date FROM ty) GROUP BY 1, 2, 3")
def split_tail_and_date(spark, d):
    t = align.split_tail(typed(spark, d), BY, ORDER, 48).withColumnRenamed("part", "tail")
    return align.split_date(t, "time", "2024-01-20 00:00:00").groupBy("sid", "tail", F.col("part").alias("date")).agg(F.count(F.lit(1)).alias("n"))


SHARE = "('0x' || substr(md5(concat_ws('|', 42, o_orderkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("split_random", "part n:l", f"SELECT CASE WHEN {SHARE} < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")
def split_random(spark, d):
    a, b = align.split_random(table(spark, d, "orders"), 0.8, keys=["o_orderkey"])
    return a.agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n")).union(b.agg(F.lit("test").alias("part"), F.count(F.lit(1)).alias("n")))


INTERPOLATE = f"""WITH {TYPED},
p AS (SELECT *, row_number() OVER ({W}) AS p FROM ty),
f AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS ya, last_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa,
  first_value(y IGNORE NULLS) OVER b AS yb, first_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb
  FROM p WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
---
SELECT sid, time, CASE WHEN y IS NOT NULL THEN y WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya ELSE ya + (yb - ya) * (p - pa) / (pb - pa) END AS y FROM f"""


@query("interpolate_linear", "sid time y:d", INTERPOLATE)
def interpolate_linear(spark, d):
    return align.interpolate(typed(spark, d), BY, ORDER, ["y"])


@query("ffill_bfill", "sid time f:d b:d", f"WITH {TYPED}\n---\nSELECT sid, time, last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM ty")
def ffill_bfill(spark, d):
    t = typed(spark, d).select("sid", "time", F.col("y").alias("f"), F.col("y").alias("b"))
    return align.fill_backward(align.fill_forward(t, BY, ORDER, ["f"]), BY, ORDER, ["b"])


@query("fill_sentinel_mask", "sid time filled:d back:d y_missing:i", f"WITH {TYPED}\n---\nSELECT sid, time, coalesce(y, -999999) AS filled, nullif(coalesce(y, -999999), -999999) AS back, CASE WHEN y IS NULL OR y = 0 THEN 1 ELSE 0 END AS y_missing FROM ty")
def fill_sentinel_mask(spark, d):
    t = align.missing_mask(typed(spark, d), ["y"]).withColumn("filled", F.col("y"))
    t = align.fill_value(t, {"filled": -999999.0}).withColumn("back", F.col("filled"))
    return align.sentinel_to_null(t, ["back"])


@query("zscore_filter", "l_orderkey:l l_linenumber:i l_extendedprice:d", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) WHERE abs(z) < 1.5")
def zscore_filter(spark, d):
    return align.remove_outliers(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 1.5)


@query("augment_noise", "time y:d")
def augment_noise(spark, d):
    return align.add_noise(hourly(spark, d), "y")


@query("union_history_future", "time y:d kind", f"WITH {HOURLY}, x AS (SELECT time, y, row_number() OVER (ORDER BY time DESC) AS k FROM h WHERE time < TIMESTAMP '2024-01-20')\n---\nSELECT time, y, 'history' AS kind FROM x WHERE k > 1 UNION ALL SELECT time, NULL, 'future' FROM h WHERE time >= TIMESTAMP '2024-01-20'")
def union_history_future(spark, d):
    h = hourly(spark, d).select("sid", "time", "y", F.lit("history").alias("kind"))
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return align.extend(h.filter(F.col("time") < cut), h.filter(F.col("time") >= cut).select("sid", "time", F.lit("future").alias("kind")), BY, ORDER)


@query("union_superset", "time y:d n:l qty:d", f"WITH {DAILY}, {SHIPPED}\n---\nSELECT time, y, n, NULL AS qty FROM d UNION ALL SELECT time, NULL, NULL, qty FROM s")
def union_superset(spark, d):
    return reshape.union_all(daily(spark, d).select("time", "y", "n"), shipped(spark, d).select("time", "qty"))


@query("calendar_parts", "o_orderkey:l dt_minute:i dt_hour:i dt_day:i dt_weekday:i dt_week:i dt_month:i dt_days_in_month:i dt_quarter:i dt_day_of_year:i dt_year:i weekend:i", "SELECT o_orderkey, minute(t) AS dt_minute, hour(t) AS dt_hour, day(t) AS dt_day, isodow(t) - 1 AS dt_weekday, weekofyear(t) AS dt_week, month(t) AS dt_month, day(last_day(t)) AS dt_days_in_month, quarter(t) AS dt_quarter, dayofyear(t) AS dt_day_of_year, year(t) AS dt_year, CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS weekend FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)")
def calendar_parts(spark, d):
    parts = ["minute", "hour", "day", "weekday", "week", "month", "days_in_month", "quarter", "day_of_year", "year"]
    return cal.calendar(table(spark, d, "orders"), "o_orderdate", parts).withColumn("weekend", cal.weekend(F.col("o_orderdate")))


@query("cyclic_time", "event_id:l dt_minute_in_day:d dt_minute_in_day_sin:d dt_minute_in_day_cos:d", "SELECT event_id, m AS dt_minute_in_day, sin(m * (2 * pi() / 288)) AS dt_minute_in_day_sin, cos(m * (2 * pi() / 288)) AS dt_minute_in_day_cos FROM (SELECT event_id, hour(ts) * 12.0::DOUBLE + minute(ts) / 5.0::DOUBLE AS m FROM events)")
def cyclic_time(spark, d):
    return cal.time_of_day(table(spark, d, "events"), "ts", 5)


@query("cyclical_feature", "p_partkey:l p_size_sin:d p_size_cos:d", "SELECT p_partkey, sin(2 * pi() * p_size / 50) AS p_size_sin, cos(2 * pi() * p_size / 50) AS p_size_cos FROM part")
def cyclical_feature(spark, d):
    return cal.cyclic(table(spark, d, "part"), "p_size", 50)


@query("interactions", "sid time qty_add_rev:d qty_substract_rev:d qty_multiply_rev:d qty_divide_rev:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, qty + rev AS qty_add_rev, qty - rev AS qty_substract_rev, qty * rev AS qty_multiply_rev, qty / (rev + 1e-8) AS qty_divide_rev FROM s")
def interactions(spark, d):
    return cal.interactions(shipped(spark, d), [("qty", "rev")])


@query("polynomials", "sid time disc_pow_2:d disc_pow_3:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, pow(disc, 2) AS disc_pow_2, pow(disc, 3) AS disc_pow_3 FROM s")
def polynomials(spark, d):
    return cal.polynomials(shipped(spark, d), ["disc"], 3)


WEATHER = f"""w AS (SELECT time AS ts, 200 + 100 * sin(2 * pi() * i / 24) AS rt_ssr, 3 + cos(2 * pi() * i / 24) AS rt_ws10, 280 + 8 * sin(2 * pi() * i / 24) AS rt_tt2, 276 + 5 * cos(2 * pi() * i / 24) AS rt_dt, 1000 + 5 * sin(2 * pi() * i / 240) AS rt_ps, 1.0 + cos(2 * pi() * i / 12) AS rt_rain FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM h) WHERE i % 7 <> 3)"""


def _weather(spark, d):
    i = F.col("i")
    base = det.time_step(hourly(spark, d), BY, ORDER, "i").filter("i % 7 <> 3")
    turn = lambda n: 2 * F.pi() * i / n
    return base.select(F.col("time").alias("ts"), (200 + 100 * F.sin(turn(24))).alias("rt_ssr"), (3 + F.cos(turn(24))).alias("rt_ws10"), (280 + 8 * F.sin(turn(24))).alias("rt_tt2"), (276 + 5 * F.cos(turn(24))).alias("rt_dt"), (1000 + 5 * F.sin(turn(240))).alias("rt_ps"), (1.0 + F.cos(turn(12))).alias("rt_rain"))


RH = "greatest(0.0, least(100.0, 100 * (6.1078 * exp(17.2693 * (rt_dt - 273.15) / (237.29 + (rt_dt - 273.15)))) / (6.1078 * exp(17.2693 * (rt_tt2 - 273.15) / (237.29 + (rt_tt2 - 273.15))))))"


@query("rel_humidity", "ts cal_rh:d", f"WITH {HOURLY}, {WEATHER}\n---\nSELECT ts, {RH} AS cal_rh FROM w")
def rel_humidity(spark, d):
    return _weather(spark, d).withColumn("cal_rh", wx.relative_humidity(F.col("rt_tt2"), F.col("rt_dt")))


@query("weather_history", "time rt_ws10:d cal_rh:d", f"""WITH {HOURLY}, {WEATHER},
j AS (SELECT h.time, w.rt_ws10, CASE WHEN w.rt_dt IS NOT NULL THEN {RH} END AS cal_rh, row_number() OVER (ORDER BY h.time) AS p FROM h LEFT JOIN w ON h.time = w.ts),
f AS (SELECT *, last_value(rt_ws10 IGNORE NULLS) OVER a AS xa, first_value(rt_ws10 IGNORE NULLS) OVER b AS xb, last_value(cal_rh IGNORE NULLS) OVER a AS ra, first_value(cal_rh IGNORE NULLS) OVER b AS rb,
 last_value(CASE WHEN rt_ws10 IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, first_value(CASE WHEN rt_ws10 IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb
 FROM j WINDOW a AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
---
SELECT time, CASE WHEN rt_ws10 IS NOT NULL THEN rt_ws10 WHEN pa IS NULL THEN xb WHEN pb IS NULL THEN xa ELSE xa + (xb - xa) * (p - pa) / (pb - pa) END AS rt_ws10,
 CASE WHEN cal_rh IS NOT NULL THEN cal_rh WHEN pa IS NULL THEN rb WHEN pb IS NULL THEN ra ELSE ra + (rb - ra) * (p - pa) / (pb - pa) END AS cal_rh FROM f""")
def weather_history(spark, d):
    return wx.add_past_weather(hourly(spark, d), _weather(spark, d), by=("sid",))[0]


@query("weather_future", "time rt_ssr:d cal_rh:d rt_ps:d rt_rain:d", f"WITH {HOURLY}, {WEATHER}\n---\nSELECT h.time, w.rt_ssr, w.rt_ws10 * 10 AS cal_rh, w.rt_ps - 50.0 AS rt_ps, w.rt_rain - 2.5 AS rt_rain FROM h LEFT JOIN w ON h.time = w.ts")
def weather_future(spark, d):
    f = _weather(spark, d).select("ts", F.col("rt_ssr").alias("pred_ssrd"), (F.col("rt_ws10") * 10).alias("pred_rh"), F.col("rt_ps").alias("pred_ps"), F.col("rt_rain").alias("pred_rain"))
    return wx.add_forecast_weather(hourly(spark, d), f)[0]


DAYS = "dt AS (SELECT DISTINCT CAST(time AS DATE) AS date, CASE WHEN month(time) = 1 AND day(time) = 1 THEN 4 WHEN isodow(time) >= 6 THEN 2 ELSE 1 END AS date_type FROM d)"


@query("datetype_join", "o_orderkey:l date_type:i", f"WITH {DAILY}, {DAYS}\n---\nSELECT o_orderkey, dt.date_type FROM orders LEFT JOIN dt ON CAST(o_orderdate AS DATE) = dt.date")
def datetype_join(spark, d):
    days = daily(spark, d).select(F.to_date("time").alias("date"), F.expr("CASE WHEN month(time) = 1 AND day(time) = 1 THEN 4 WHEN weekday(time) >= 5 THEN 2 ELSE 1 END").alias("date_type"))
    return wx.add_day_type(table(spark, d, "orders"), days, "o_orderdate")


@query("as_of_join", "event_id:l seen:d", "SELECT e.event_id, p.value AS seen FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("seen"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["seen"])


@query("join_inner_outer", "time y:d qty:d", f"WITH {DAILY}, {SHIPPED}, x AS (SELECT time, sum(qty) AS qty FROM s GROUP BY time)\n---\nSELECT coalesce(d.time, x.time) AS time, d.y, x.qty FROM d FULL JOIN x ON d.time = x.time")
def join_inner_outer(spark, d):
    x = shipped(spark, d).groupBy("time").agg(F.sum("qty").alias("qty"))
    return joins.concat_columns(daily(spark, d).select("time", "y"), x, ["time"])


@query("join_aligned", "time n:l qty:d", f"WITH {DAILY}, {SHIPPED}, x AS (SELECT time, sum(qty) AS qty FROM s GROUP BY time)\n---\nSELECT d.time, d.n, x.qty FROM d JOIN x ON d.time = x.time")
def join_aligned(spark, d):
    return joins.align_inner(daily(spark, d).select("time", "n"), shipped(spark, d).groupBy("time").agg(F.sum("qty").alias("qty")), ["time"])


@query("target_encode", "o_orderkey:l o_orderpriority_encoded:d", "SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) / 1000 AS o_orderpriority_encoded FROM orders")
def target_encode(spark, d):
    return joins.target_encode(table(spark, d, "orders").withColumn("y", F.col("o_totalprice")), "o_orderpriority", "y").withColumn("o_orderpriority_encoded", F.col("o_orderpriority_encoded") / 1000)


@query("code_lookup", "s_suppkey:l nation", "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def code_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return joins.lookup(table(spark, d, "supplier"), n, ["s_nationkey"])


ASSETS = "a AS (SELECT time, CASE sid WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS id, rev FROM s)"


def _assets(spark, d):
    return shipped(spark, d).select("time", F.expr("CASE sid WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("id"), "rev")


@query("pair_gather", "time i:i j:i left:d right:d spread:d", f"WITH {SHIPPED}, {ASSETS}, p AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, -1)) AS v(i, j))\n---\nSELECT l.time, p.i, p.j, l.rev AS \"left\", coalesce(r.rev, 0) AS \"right\", l.rev - coalesce(r.rev, 0) AS spread FROM a l JOIN p ON l.id = p.i LEFT JOIN a r ON l.time = r.time AND r.id = p.j WHERE p.j = -1 OR r.rev IS NOT NULL")
def pair_gather(spark, d):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, -1)], "i int, j int")
    return joins.gather_pairs(_assets(spark, d), pairs, "time", "id", "rev")


@query("unpivot_assets", "sid time name value:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, 'qty' AS name, qty AS value FROM s UNION ALL SELECT sid, time, 'rev', rev FROM s UNION ALL SELECT sid, time, 'disc', disc FROM s")
def unpivot_assets(spark, d):
    return reshape.unpivot(shipped(spark, d), ["sid", "time"], ["qty", "rev", "disc"])


@query("pivot_panel", "time A:d N:d R:d", f"WITH {SHIPPED}\n---\nSELECT time, max(qty) FILTER (sid = 'A') AS \"A\", max(qty) FILTER (sid = 'N') AS \"N\", max(qty) FILTER (sid = 'R') AS \"R\" FROM s GROUP BY time")
def pivot_panel(spark, d):
    return reshape.pivot(shipped(spark, d), ["time"], "sid", "qty", ["A", "N", "R"])


@query("vector_per_date", "time n:i total:d", f"WITH {SHIPPED}\n---\nSELECT time, 2 * count(*) AS n, sum(qty + rev) AS total FROM s GROUP BY time")
def vector_per_date(spark, d):
    v = reshape.vector(shipped(spark, d), ["time"], "sid", ["qty", "rev"])
    return v.select("time", F.size("vector").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("topk_tail", "sid time y:d", f"WITH {TYPED}\n---\nSELECT sid, time, y FROM ty QUALIFY row_number() OVER (PARTITION BY sid ORDER BY time DESC) <= 24")
def topk_tail(spark, d):
    return reshape.last_rows(typed(spark, d), BY, ORDER, 24)


@query("sort_head", "o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_head(spark, d):
    return reshape.top(table(spark, d, "orders"), "o_totalprice", 50, ["o_orderkey"])


@query("argmin_model", "sid time best_model", f"WITH {SHIPPED}\n---\nSELECT sid, time, CASE WHEN disc <= qty AND disc <= rev THEN 'disc' WHEN qty <= rev THEN 'qty' ELSE 'rev' END AS best_model FROM s")
def argmin_model(spark, d):
    return reshape.best_model(shipped(spark, d), ["disc", "qty", "rev"])


@query("one_hot", "o_orderkey:l o_orderstatus_F:i o_orderstatus_O:i o_orderstatus_P:i", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS \"o_orderstatus_F\", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"o_orderstatus_O\", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS \"o_orderstatus_P\" FROM orders")
def one_hot(spark, d):
    return cal.one_hot(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"])


@query("category_codes", "o_orderkey:l code:i", "WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'))\n---\nSELECT o_orderkey, coalesce(c.code, 0) AS code FROM orders LEFT JOIN c ON o_orderpriority = c.v")
def category_codes(spark, d):
    o = table(spark, d, "orders")
    codes = encode.fit_codes(o.filter("o_orderdate < timestamp_ntz'1998-01-01'"), "o_orderpriority")
    return encode.encode(o, codes, "o_orderpriority").withColumnRenamed("o_orderpriority_code", "code")


def _scaled(kind):
    def run(spark, d):
        c = table(spark, d, "lineitem")
        cols = ["l_quantity", "l_extendedprice"]
        return encode.scale(c, encode.fit_scaler(c, cols, kind), cols)

    return run


query("scale_standard", "l_orderkey:l l_linenumber:i l_quantity:d l_extendedprice:d", "SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS l_extendedprice FROM lineitem")(_scaled("standard"))
query("scale_minmax", "l_orderkey:l l_linenumber:i l_quantity:d l_extendedprice:d", "SELECT l_orderkey, l_linenumber, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity, (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS l_extendedprice FROM lineitem")(_scaled("minmax"))


@query("inverse_scale", "sid time y:d", f"WITH {TYPED}\n---\nSELECT sid, time, y FROM ty")
def inverse_scale(spark, d):
    t = typed(spark, d)
    p = encode.fit_scaler(t, ["y"])
    return encode.unscale(encode.scale(t, p, ["y"]).withColumnRenamed("y", "z"), p, "z", "y").withColumnRenamed("z", "y")


@query("box_cox", "sid time z:d", f"WITH {SHIPPED}\n---\nSELECT sid, time, (pow(qty, 0.5) - 1) / 0.5 AS z FROM s")
def box_cox(spark, d):
    return encode.box_cox(shipped(spark, d), "qty", 0.5, "z")


@query("date_parsing", "o_orderkey:l first:d label", "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) * 4 + quarter(o_orderdate) AS first, strftime(o_orderdate, '%Y-%m-%d') AS label FROM orders")
def date_parsing(spark, d):
    o = table(spark, d, "orders").withColumn("raw", F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = align.parse_time(o, "raw", "yyyy-MM-dd")
    return o.select("o_orderkey", (F.year("raw") * 4 + F.quarter("raw")).alias("first"), F.date_format("raw", "yyyy-MM-dd").alias("label"))


@query("range_label", "sid label", f"WITH {TYPED}\n---\nSELECT sid, strftime(min(time), '%Y-%m-%d %H:%M:%S') || '~' || strftime(max(time), '%Y-%m-%d %H:%M:%S') AS label FROM ty GROUP BY sid")
def range_label(spark, d):
    return typed(spark, d).groupBy("sid").agg(cal.range_label("time").alias("label"))


@query("fourier", "time sin_year_1:d cos_year_1:d sin_year_2:d cos_year_2:d", f"WITH {DAILY}, a AS (SELECT time, (dayofyear(time) - 1) / CASE WHEN dayofyear(make_date(year(time), 12, 31)) = 366 THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END AS f FROM d)\n---\nSELECT time, sin(2 * pi() * f) AS sin_year_1, cos(2 * pi() * f) AS cos_year_1, sin(4 * pi() * f) AS sin_year_2, cos(4 * pi() * f) AS cos_year_2 FROM a")
def fourier(spark, d):
    return cal.fourier(daily(spark, d), cal.year_turn(F.col("time")), 2)


@query("gen_sine", "t:l y:d", "SELECT i AS t, 5 * sin(2 * pi() * i / 24) + 2 * sin(2 * pi() * i / 168) + 1 + 0.01 * i AS y FROM range(1000) AS r(i)")
def gen_sine(spark, d):
    return gen.seasonal(spark, 1000, [24, 168], [5, 2], quadratic=(1.0, 0.01, 0.0))


@query("gen_drift", "series_id:l t:l y:d", "SELECT i % 3 AS series_id, i // 3 AS t, 0.5 * (i // 3 + 1) AS y FROM range(900) AS r(i)")
def gen_drift(spark, d):
    return gen.random_walk(spark, 300, drift=0.5, noise=False, series=3)


@query("gen_noise_walk", "t:l y:d")
def gen_noise_walk(spark, d):
    return gen.random_walk(spark, 500).select("t", "y").unionByName(gen.white_noise(spark, 500))


@query("gen_load_weather", "data_time real_power:d temp:d weather_code:i")
def gen_load_weather(spark, d):
    return gen.load_and_weather(spark, 3)

"""Queries of a day ahead in five-minute steps: 288 of them, directly and recursively."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators.align import on_grid, own_grid
from chronoloom.plans import horizon as hz
from chronoloom.plans import strategies as fc
from chronoloom.queries.base import BY, query, table
from chronoloom.queries.fitted_sql import column, dot, doubles, solve

STEPS, LAGS = 288, (1, 2, 12)

FIVE = """fa AS (SELECT event_type AS sid, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS TIMESTAMP) AS time, count(*) AS y, avg(value) AS x FROM events GROUP BY 1, 2),
fg AS (SELECT sid, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS time FROM (SELECT sid, min(time) AS a, max(time) AS b FROM fa GROUP BY sid)),
f5 AS (SELECT fg.sid, fg.time, coalesce(fa.y, 0)::DOUBLE AS y, coalesce(fa.x, 0) AS x, row_number() OVER (PARTITION BY fg.sid ORDER BY fg.time) AS i, count(*) OVER (PARTITION BY fg.sid) AS m FROM fg LEFT JOIN fa ON fa.sid = fg.sid AND fa.time = fg.time)"""
_lagged = doubles(["1", *[f"lag(y, {k}) OVER o" for k in LAGS], "x"])

DIRECT = f"""WITH RECURSIVE {FIVE}, l AS (SELECT sid AS k, i, m, {_lagged} AS x, list(y) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN CURRENT ROW AND {STEPS - 1} FOLLOWING) AS y FROM f5 WINDOW o AS (PARTITION BY sid ORDER BY i)),
r AS (SELECT k, x, y FROM l WHERE i > {max(LAGS)} AND i <= m - {STEPS - 1}), {solve("s", "r", 2 + len(LAGS), STEPS)},
z AS (SELECT sid, max(time) AS t, {doubles(["1", *[f"list(y ORDER BY i)[-{k}]" for k in LAGS], f"list(x ORDER BY i)[-{STEPS}]"])} AS x FROM f5 GROUP BY sid)
---
SELECT z.sid, z.t + h * INTERVAL 5 MINUTE AS time, h AS step, {dot("list_transform(s.w, lambda q: q[h])", "z.x")} AS predict_value FROM z JOIN s ON s.k = z.sid, (SELECT unnest(range(1, {STEPS + 1})) AS h)"""

_held = doubles(["1", *[f"z.ys[{1 + max(LAGS) - k}]" for k in LAGS], "b.x"])
RECURSIVE = f"""WITH RECURSIVE {FIVE}, l AS (SELECT 0 AS k, i, {_lagged} AS x, [y] AS y FROM f5 WINDOW o AS (PARTITION BY sid ORDER BY i)), r AS (SELECT k, x, y FROM l WHERE i > {max(LAGS)}), {solve("s", "r", 2 + len(LAGS), 1)},
z AS (SELECT sid, 0 AS step, max(time) AS t, list(y ORDER BY i)[-{max(LAGS)}:] AS ys, max(m) AS m FROM f5 GROUP BY sid
  UNION ALL SELECT z.sid, step + 1, t, list_append(ys[2:], {dot(column("s.w"), _held)}), z.m FROM z JOIN f5 b ON b.sid = z.sid AND b.i = z.m - {STEPS} + z.step + 1, s WHERE step < {STEPS})
---
SELECT sid, t + step * INTERVAL 5 MINUTE AS time, step, ys[{max(LAGS)}] AS predict_value FROM z WHERE step > 0"""


def _five(spark, d):
    """sid, time, y (events), x (their mean value), a row for each five minutes."""
    cell = F.window("ts", "5 minutes").getField("start").alias("time")
    got = table(spark, d, "events").groupBy(F.col("event_type").alias("sid"), cell).agg(F.count("*").cast("double").alias("y"), F.avg("value").alias("x"))
    return on_grid(own_grid(got, BY, "time", "5 minutes"), got, ["sid", "time"]).fillna(0.0, ["y", "x"])


@query("direct_288", "sid time step:i predict_value:d", DIRECT)
def direct_288(spark, d):
    s = _five(spark, d)
    return hz.direct_long(s, hz.reuse_last(s, BY, ["x"], STEPS, "5 minutes"), BY, "y", ["y"], ["x"], LAGS, STEPS)


@query("recursive_288", "sid time step:i predict_value:d", RECURSIVE)
def recursive_288(spark, d):
    s = _five(spark, d)
    return fc.forecast("USMR", s, hz.reuse_last(s, BY, ["x"], STEPS, "5 minutes"), BY, "y", ["y"], ["x"], LAGS, STEPS)

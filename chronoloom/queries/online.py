"""Queries of streams in append mode: models that every observation updates, windows closed by the watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.queries.base import query, table
from chronoloom.streaming import streams

#: Ridge regression of all observations of a user by Cramer's rule; the penalty is one.
ONLINE_SQL = """WITH e AS (SELECT user_id, value AS y, hour(ts)::DOUBLE AS a, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10 AS b FROM events),
s AS (SELECT user_id, count(*) AS n, count(*) + 1.0::DOUBLE AS m, sum(a) AS a, sum(b) AS b, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(y) AS y, sum(a * y) AS ay, sum(b * y) AS bz FROM e GROUP BY user_id),
d AS (SELECT *, m * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s)
---
SELECT user_id, n, (y * (aa * bb - ab * ab) - a * (ay * bb - ab * bz) + b * (ay * ab - aa * bz)) / det AS w0,
  (m * (ay * bb - ab * bz) - y * (a * bb - ab * b) + b * (a * bz - ay * b)) / det AS w1,
  (m * (aa * bz - ay * ab) - a * (a * bz - ay * b) + y * (a * ab - aa * b)) / det AS w2 FROM d"""


def _events(spark, d):
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return source.withColumn("y", F.col("value")).withColumn("a", F.hour("ts").cast("double")).withColumn("b", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double") / 10)


@query("stream_online_regression", "user_id:l n:l w0:d w1:d w2:d", ONLINE_SQL)
def stream_online_regression(spark, d):
    """Each user's last weights after one update an event."""
    made = streams.online_regression(_events(spark, d), "user_id", "ts", "y", ["a", "b"])
    got = streams.run_to_end(made, "online", "append", spark, settings=streams.STATE)
    last = got.groupBy("user_id").agg(F.max_by("weights", "n").alias("w"), F.max("n").alias("n"))
    return last.select("user_id", "n", *[F.col("w")[k].alias(f"w{k}") for k in range(3)])


@query("stream_append_windows", "ts event_type y:d n:l", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type, avg(value) AS y, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)")
def stream_append_windows(spark, d):
    """Hourly means once the watermark has passed their window, each written once."""
    made = streams.resample(_events(spark, d), "ts", "1 hour", "value", ("event_type",), delay="2 hours")
    return streams.run_to_end(made, "append", "append", spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

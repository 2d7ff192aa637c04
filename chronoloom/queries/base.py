"""The registry, and the series that queries read from the tables.

A query's columns are declared once, as in ``sid time y:d n:l``; the same projection is
put around the DataFrame and around the SQL: ``d`` is a double rounded to six digits (see OFF_TIES),
``l`` a long, ``i`` an int.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Means of values with few decimals often lie on a tie of the six digits that are compared, where engines round apart by the last bit.
#: Rounding after this much, on both sides, moves the ties off such values; what is returned is still within one unit of the sixth digit.
OFF_TIES = 1.37e-9


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((c + ":").split(":")[:2]) for c in spec.split()]


def query(name: str, spec: str, sql: str | None = None):
    cols = _columns(spec)

    def register(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = []
            for c, kind in cols:
                x = F.col(f"`{c}`")
                out.append({"d": F.round(x.cast("double") + OFF_TIES, 6) + 0.0, "l": x.cast("long"), "i": x.cast("int")}.get(kind, x).alias(c))
            return make(spark, sf_dir).select(*out)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            picked = ", ".join({"d": f'round(CAST("{c}" AS DOUBLE) + {OFF_TIES}::DOUBLE, 6) + 0.0', "l": f'CAST("{c}" AS BIGINT)', "i": f'CAST("{c}" AS INTEGER)'}.get(k, f'"{c}"') + f' AS "{c}"' for c, k in cols)
            body = sql.strip()
            if body.upper().startswith("WITH"):
                head, _, last = body.rpartition("\n---\n")
                ORACLE_SQL[name] = f"{head}\nSELECT {picked} FROM ({last.strip()})"
            else:
                ORACLE_SQL[name] = f"SELECT {picked} FROM ({body})"
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """sid, time, y, n: mean event value by hour."""
    hour = F.window("ts", "1 hour").getField("start").alias("time")
    return table(spark, d, "events").groupBy(hour).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n")).withColumn("sid", F.lit("all"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """sid, time, y by event type, on each type's own hourly grid, with gaps."""
    from chronoloom.operators.align import on_grid, own_grid

    hour = F.window("ts", "1 hour").getField("start").alias("time")
    got = table(spark, d, "events").groupBy(F.col("event_type").alias("sid"), hour).agg(F.avg("value").alias("y"))
    return on_grid(own_grid(got, ["sid"], "time", "1 hour"), got, ["sid", "time"])


def daily(spark: SparkSession, d: str) -> DataFrame:
    """sid, time, y (thousands), n: orders by day."""
    day = F.window("o_orderdate", "1 day").getField("start").alias("time")
    return table(spark, d, "orders").groupBy(day).agg((F.sum("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).alias("n")).withColumn("sid", F.lit("all"))


def shipped(spark: SparkSession, d: str) -> DataFrame:
    """sid (return flag), time, qty, rev (thousands), disc by ship day."""
    day = F.window("l_shipdate", "1 day").getField("start").alias("time")
    rev = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sid"), day).agg(F.sum("l_quantity").alias("qty"), rev.alias("rev"), F.avg("l_discount").alias("disc"))


def supplied(spark: SparkSession, d: str) -> DataFrame:
    """sid (supplier), time, y: quantity by ship day, for the days that have any; series grow in number with the tables."""
    day = F.window("l_shipdate", "1 day").getField("start").alias("time")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), day).agg(F.sum("l_quantity").alias("y"))


#: The same series as common table expressions.
HOURLY = "h AS (SELECT 'all' AS sid, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, avg(value) AS y, count(*) AS n FROM events GROUP BY 2)"
TYPED = """ta AS (SELECT event_type AS sid, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, avg(value) AS y FROM events GROUP BY 1, 2),
tg AS (SELECT sid, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM (SELECT sid, min(time) AS a, max(time) AS b FROM ta GROUP BY sid)),
ty AS (SELECT tg.sid, tg.time, ta.y FROM tg LEFT JOIN ta ON tg.sid = ta.sid AND tg.time = ta.time)"""
DAILY = "d AS (SELECT 'all' AS sid, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS time, sum(o_totalprice) / 1000 AS y, count(*) AS n FROM orders GROUP BY 2)"
SHIPPED = "s AS (SELECT l_returnflag AS sid, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS time, sum(l_quantity) AS qty, sum(l_extendedprice * (1 - l_discount)) / 1000 AS rev, avg(l_discount) AS disc FROM lineitem GROUP BY 1, 2)"
SUPPLIED = "h AS (SELECT l_suppkey AS sid, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS time, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"

BY, ORDER = ["sid"], ["time"]
W = "PARTITION BY sid ORDER BY time"

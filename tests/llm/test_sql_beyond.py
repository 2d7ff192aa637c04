"""SQL held against operators where the registered sizes don't reach: shards that split many times; and the spelling query on the given documents."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import sharding, spelling


def rows(sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("limit", [200_000, 20_000, 300])
def test_shards_that_split(spark, sf, limit):
    found = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), limit)
    found = found.select("doc_id", "size", F.concat(F.lit("s"), "shard").alias("shard"), "depth", "shard_bytes", "oversized")
    names, want = rows(sharding.OP6_SQL.replace("16777216", str(limit)), sf)
    assert names == found.columns and sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert len({r[2] for r in want}) > 1 and max(r[3] for r in want) > 1


def test_spelling_query(spark, sf):
    got = spelling.op13_spelling(spark, sf)
    names, want = rows(spelling.OP13_SQL, sf)
    assert names == got.columns and {tuple(r) for r in got.collect()} == set(want) and got.count() == len(want) > 100

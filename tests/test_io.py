"""Readers, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from chronoloom.queries.base import table
from chronoloom.sources import io
from chronoloom.streaming import streams


def test_csv_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    io.write_csv(df, str(tmp_path / "t"))
    got = io.read_csv(spark, str(tmp_path / "t"), "a int, b double", ["b"])
    assert sorted((r.b for r in got.collect()), key=str) == [2.5, None]
    b = io.read_bundle(spark, str(tmp_path / "t"), {"weather": str(tmp_path / "none")}, "csv")
    assert list(b) == ["target_series"]
    with pytest.raises(FileNotFoundError):
        io.read_bundle(spark, str(tmp_path / "none"), {})


def test_labelled_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\t2\t3\n0\t4\t5\n")
    (tmp_path / "x.weight").write_text("0.5\n2\n")
    got = io.read_labelled_tsv(spark, str(tmp_path / "x.tsv"), 2, str(tmp_path / "x.weight")).orderBy("label").collect()
    assert [(r.label, r.f1, r.weight) for r in got] == [(0, 5, 2), (1, 3, 0.5)]


def test_unit_row(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time,Hs\nUTC,m\n2024-01-01 00:00:00,1.5\n")
    got = io.read_csv_with_units(spark, str(tmp_path / "b.csv"), ["Hs"], "time", {"Hs": "SWH"}).collect()
    assert [r.SWH for r in got] == [1.5]


def test_write_once(spark, tmp_path):
    a, b = spark.range(2), spark.range(5)
    io.write_once(a, str(tmp_path / "o"))
    io.write_once(b, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_stream_equals_batch(spark, sf):
    batch = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").getField("start").alias("ts")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"))
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf)
    got = streams.run_to_end(streams.resample(source, "ts", "1 hour", "value"), "hourly_stream", "complete", spark)
    assert sorted((str(r.ts), r.n) for r in got.collect()) == sorted((str(r.ts), r.n) for r in batch.collect())

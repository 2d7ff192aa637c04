"""Columns of the user's that are named like the operators' own, limits of written shards, and large benchmarks."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import bpe, common, decontam, nearjaccard, quality, sharding, simhash
from tests.llm.test_operators import docs, empty, leaks, texts  # noqa: F401

OWN = ["_leak_id", "_leak_th", "_leak_spans", "_near_id", "_near_th", "_id", "_th", "_w", "pos", "len", "gh", "_place", "bits", "size", "shard", "depth", "row", "th", "code"]


@pytest.fixture(scope="module")
def crowded(docs):  # noqa: F811
    return docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in OWN})


@pytest.fixture(scope="module")
def bench(spark):
    t = texts()
    return spark.createDataFrame([(1, " ".join(t[0].split()[5:25])), (2, t[3].upper()), (10, "one-two"), (None, " ".join(t[11].split()[100:110]))], "item_id long, text string")


def same(df):
    return all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in df.collect() for c in OWN)


def test_columns_come_back(crowded, bench):
    for out in (decontam.drop_leaks(crowded, bench), decontam.cut_leaks(crowded, bench), simhash.keep_one(crowded), nearjaccard.keep_one(crowded)):
        assert out.columns == crowded.columns and same(out) and out.count()


def test_written_shards_keep_the_limit(spark, crowded, tmp_path):
    name = sharding.write_shards(crowded, str(tmp_path / "a"), 20_000)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert name == "shard_" and back.count() == crowded.count() and same(back) and set(back.columns) == {*crowded.columns, name}
    equal = spark.createDataFrame([(1, "x" * 1000)] * 50, "doc_id long, text string")
    sharding.write_shards(equal, str(tmp_path / "b"), 5000)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "b")).groupBy("shard").count().collect()]
    assert sum(sizes) == 50 and max(sizes) <= 5


@pytest.mark.parametrize("most", [1000, 0])  # the n-grams don't fit a broadcast, nor do their hashes
def test_large_benchmarks(spark, docs, bench, monkeypatch, most):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [tuple(r) for r in bench.collect()]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.find_leaks(docs, bench).collect()), key=str)
    assert got == leaks(rows, items)


def test_cut_leaks(spark, docs, empty, bench):  # noqa: F811
    t = texts()
    out = {r.doc_id: r.text for r in decontam.cut_leaks(docs, bench).collect()}
    w = t[0].split()
    assert out[0] == " ".join(w[:5]) + "  " + " ".join(w[25:]) and out[4] is None and out[5] == "" and out[7] == "one"
    one = spark.createDataFrame([(1, "Say: One, two! And more; one two."), (2, None)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in decontam.cut_leaks(one, bench).collect()}
    assert cut == {1: "Say: ! And more; .", 2: None}
    left = [(r.doc_id, r.text) for r in decontam.cut_leaks(docs, bench).collect()]
    assert Counter(i for i, _ in left) == Counter(r.doc_id for r in docs.collect())
    assert decontam.cut_leaks(empty, bench).count() == 0


def test_a_labelled_id_with_several_texts(spark):
    rows = [(i, ("good words here " if i % 2 else "b@d $$$ ") * (2 + i % 7)) for i in range(60)] + [(i, "zzz") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a, b = (quality.learn(x, labels) for x in (df, df.orderBy(F.desc("text")).repartition(3)))
    assert a.cut == b.cut and (a.weight == b.weight).all()


def test_a_missing_tokenizer_is_an_error(docs):  # noqa: F811
    with pytest.raises(Exception, match="no_such_tokenizer"):
        bpe.encode(docs, "/tmp/no_such_tokenizer.json").collect()


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        common.shared_folder(Session())
    assert os.path.isdir(common.shared_folder(spark).removeprefix("file://"))

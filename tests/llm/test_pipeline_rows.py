"""The whole pipeline on odd tables: nulls, empty texts, repeated rows, an empty table; the session's settings stay."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n)).capitalize() + "."


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(99, 40)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    docs = [(i, words(i, 120) if i % 4 else "!!! ### " * 60, "en", "s", None) for i in range(80)]
    docs += [(100, words(1, 120) + " " + words(500, 2), "en", "s", 1), (101, words(7, 60) + " " + words(99, 40) + " " + words(8, 60), "en", "s", 1)]
    docs += [(102, words(9, 100) + " password=hunter2hunter2 " + words(10, 20), "en", "s", 1), docs[5], (103, None, None, None, None), (104, "", "en", "s", 0), (None, words(11, 90), "en", "s", 1)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(60)]
    before = spark.conf.get(BATCH)
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs, labels))
    assert spark.conf.get(BATCH) == before and got.columns == ["doc_id", "n_tokens", "ids"]
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(5) == 1 and 1 in ids and 100 not in ids and 101 not in ids and 102 in ids
    assert not {0, 4, 8} & set(ids) and {2, 3, 6, 7, 9} <= set(ids)


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).collect() == []

"""The near-dedup stage runs few tasks on few rows, however many partitions a shuffle has."""

import random

import pytest
from chronoloom.llm import nearjaccard


@pytest.fixture
def many_parts(spark):
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def documents(spark):
    r = random.Random(9)
    rows = []
    for _ in range(6):  # chains of near copies, and a copy of each
        text = [f"w{r.randrange(3000)}" for _ in range(150)]
        for _ in range(5):
            text[r.randrange(150)] = f"c{r.randrange(10**6)}"
            rows += [" ".join(text)] * 2
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_few_tasks(spark, many_parts):
    docs = documents(spark)
    store = spark.sparkContext._jsc.sc().statusTracker()
    seen = set(store.getJobIdsForGroup(None))
    assert {(x.doc_id, x.component_id) for x in nearjaccard.near_groups(docs).collect()} == {(i, i - i % 10) for i in range(60)}
    jobs = [store.getJobInfo(j).get() for j in store.getJobIdsForGroup(None) if j not in seen]
    stages = {k for j in jobs for k in j.stageIds()}
    ran = [s.get().numCompletedTasks() for s in map(store.getStageInfo, stages) if s.isDefined()]
    assert 0 < sum(ran) < 40 * 60


def test_components_in_one_task_or_many(spark, monkeypatch):
    docs = documents(spark)
    one = {(x.doc_id, x.root, x.component_id) for x in nearjaccard.near_groups(docs).collect()}
    monkeypatch.setattr(nearjaccard, "LOCAL", -1)
    assert {(x.doc_id, x.root, x.component_id) for x in nearjaccard.near_groups(docs).collect()} == one


def test_without_broadcasts(spark, monkeypatch):
    docs = documents(spark)
    one = {(x.doc_id, x.root, x.component_id) for x in nearjaccard.near_groups(docs).collect()}
    monkeypatch.setattr(nearjaccard, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(nearjaccard, "small", lambda df, rows, row_bytes: df)
    assert {(x.doc_id, x.root, x.component_id) for x in nearjaccard.near_groups(docs).collect()} == one

"""Components and joins where one key holds most rows."""

import numpy as np

from chronoloom.llm import simhash


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_hubs_at_either_end_and_many_small_components(spark):
    rng = np.random.default_rng(5)
    edges = [(10**6, i) for i in range(3000)] + [(-5, 5000 + i) for i in range(3000)] + [(20_000 + 3 * i, 20_001 + 3 * i) for i in range(2500)]
    edges += [(int(a), int(b)) for a, b in rng.integers(40_000, 44_000, (2500, 2))] + [(7, 7), (50_000, 50_000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items() if k != v}
    assert {k: v for k, v in got.items() if k != v} == want


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_join_of_hot_and_rare_keys(spark):
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(6000)], "k long, x long")
    named = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS y")
    got = simhash.join_hot(rows, named, "k", 6000)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, 2 * k) for i in range(6000) for k in [0 if i % 3 == 0 else i])


def test_one_fingerprint_holds_most_rows(spark):
    docs = spark.createDataFrame([(i, "the same words in every copy of this text" if i % 4 else f"text number {i} of its own, {i * i} and {i * 7}") for i in range(2000)] + [(None, "the same words in every copy of this text")], "doc_id long, text string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == 2001
    assert {r["component_id"] for r in got if r["doc_id"] is None or r["doc_id"] % 4} == {1}

"""Nearest vectors of more queries than one block holds."""

import math
import random

from chronoloom.operators import anomaly as ad


def test_more_queries_than_a_block(spark):
    rows = [(-1, [0.0, 0.0]), (-2, [300.0, 400.0]), (-3, [1000.0, 0.0])]
    asked = [(i, [float(i % 997), float(i // 997)]) for i in range(20_001)]
    df, queries = (spark.createDataFrame(x, "id long, v array<double>") for x in (rows, asked))
    got = {r.id: (r.knn_mean, r.knn_max) for r in ad.vector_knn(df, queries, "id", "v", 2).collect()}
    assert len(got) == len(asked)
    for i, v in asked:
        d = sorted(math.dist(v, x) for _, x in rows)[:2]
        assert math.isclose(got[i][0], sum(d) / 2) and math.isclose(got[i][1], d[1])


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    """More rows than a block, copies, keys twice, nulls, other lengths, infinite and huge entries."""
    monkeypatch.setattr(ad, "VECTOR_BLOCK", 16)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(7, [0.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0]), (303, [2.0]), (304, [math.inf, 0.0, 0.0, 0.0]), (305, [1e200, 0.0, 0.0, 0.0]), (None, [0.0] * 4)]
    asked = [x for x in rows if x[0] is not None and (x[0] % 5 == 0 or x[0] > 299 or x[0] == 7)]
    df, queries = (spark.createDataFrame(x, "id long, v array<double>") for x in (rows, asked))
    got = {x.id: (x.knn_mean, x.knn_max) for x in ad.vector_knn(df, queries, "id", "v", 3).collect()}
    assert set(got) == {x[0] for x in asked}

    def far(a, b):
        return None if a is None or b is None or len(a) != len(b) or None in (*a, *b) else math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))

    for key in got:
        d = [far(v, x) for q, v in asked if q == key for i, x in rows if i is not None and i != key]
        d = sorted((x for x in d if x is not None), key=lambda x: (math.isnan(x), x))[:3]
        want = (sum(d) / len(d), max(d)) if d else (None, None)
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) or math.isnan(a) and math.isnan(b) for a, b in zip(got[key], want, strict=True)), (key, got[key], want)

"""The quality classifier learns from every labelled training row and every pair of them."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import quality


def text(r, good):
    drawn = [f"word{r.randrange(300)}" + ("" if good or r.random() < 0.7 else "$#") for _ in range(r.randrange(4, 40))]
    return (" " if r.random() < 0.5 else "\n").join(w.upper() if r.random() < 0.2 else w for w in drawn)


def test_weights_are_least_loss_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 90, raising=False)
    r = random.Random(3)
    rows = [(i, text(r, i % 3 > 0)) for i in range(500)]
    label = {i: int((i % 3 > 0) != (r.random() < 0.1)) for i in range(500)}
    got = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, quality int"))
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % quality.FOLDS]
    x, y = np.stack([quality.features(t) for _, t in train]), np.array([label[i] for i, _ in train])
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.scale, scale)
    z = np.clip((x - x.mean(0)) / scale, -6, 6)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    slope = -(d / (1 + np.exp(d @ got.weight))[:, None]).mean(0) + 1e-3 * got.weight
    assert np.abs(slope).max() < 1e-4
    u = z @ got.weight
    wrong = lambda c: (u[y == 1] < c).sum() + (u[y == 0] >= c).sum()
    assert wrong(got.cut) <= min(map(wrong, np.quantile(u, np.linspace(0.005, 0.6, 240)))) + 1


def test_no_labelled_row_is_left_out(spark):
    """The bad texts are those of the last 200 ids by hash, of more than twenty thousand."""
    ids = spark.range(26_000).filter(F.crc32(F.col("id").cast("string")) % quality.FOLDS != 0).orderBy(F.xxhash64("id"), "id")
    ids = [x.id for x in ids.collect()]
    assert len(ids) > 20_200
    bad = set(ids[-200:])
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "$$ ## %%" if i in bad else f"some plain words {r.randrange(99)}") for i in ids], "doc_id long, text string").repartition(4)
    ranker = quality.learn(docs, spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int"))
    low = quality.with_score(docs, ranker).filter(F.col("quality_score") < quality.THRESHOLD)
    assert {x.doc_id for x in low.collect()} == bad

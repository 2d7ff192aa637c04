"""Histogram trees against plain Python trees on small tables, with nulls, ties, constant columns and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.plans import trees
from chronoloom.plans.trees import AdaBoost, Boosting, ExtraTrees, Penalty

SCHEMA = "a double, b double, c double, y double, z double, late boolean"


def table(n, seed, holes=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.choice([0.0, 1.0, 2.0, 5.0, 9.0]), r.gauss(0, 1)
        y = 3 * (a > 1) + b + r.gauss(0, 0.2)
        rows.append((None if holes and i % 11 == 0 else float("nan") if holes and i % 17 == 0 else a, b, 7.0, None if holes and i % 23 == 0 else y, a - b, i % 4 == 0))
    return rows + rows[:3]


def arrays(rows, targets):
    full = [r for r in rows if all(r[t] is not None for t in targets)]
    x = np.array([[np.nan if v is None else v for v in r[:3]] for r in full])
    return x, np.array([[r[t] for t in targets] for r in full]), np.array([r[5] for r in full])


def plain_tree(codes, grad, penalty, leaves, depth, features):
    """{path: rows} of the leaves of a tree grown one leaf at a time, every cut tried row by row."""

    def score(g, h):
        g = np.sign(g) * np.maximum(np.abs(g) - penalty.l1, 0)
        return float((g**2).sum() / (h + penalty.l2)) if h + penalty.l2 > 0 else 0.0

    def best(at):
        out = None
        for f in features:
            for cut in range(1, int(codes[:, f].max(initial=0)) + 1):
                for missing in (False, True) if (codes[at, f] == 0).any() else (False,):
                    go = np.where(codes[at, f] == 0, missing, codes[at, f] <= cut)
                    l, r = at[go], at[~go]
                    if min(len(l), len(r)) < max(penalty.rows, 1):
                        continue
                    gain = score(grad[l].sum(0), len(l)) + score(grad[r].sum(0), len(r)) - score(grad[at].sum(0), len(at))
                    if gain > 1e-9 and (out is None or gain > out[0] + 1e-9):
                        out = (gain, l, r)
        return out

    held = {"": np.arange(len(codes))}
    while len(held) < leaves:
        able = [(p, b) for p, at in held.items() if len(p) < depth and (b := best(at))]
        if not able:
            break
        p, (_, l, r) = min(able, key=lambda x: (-round(x[1][0], 9), len(x[0]), x[0]))
        del held[p]
        held |= {p + "0": l, p + "1": r}
    return held


def plain_boosting(x, y, learner, codes, late=None):
    train = np.flatnonzero(~late) if late is not None else np.arange(len(y))
    absolute = learner.objective == "mae"
    start = np.percentile(y[train], 50, axis=0, method="inverted_cdf") if absolute else y[train].mean(0)
    m, history = np.tile(start, (len(y), 1)), []
    loss = lambda at: float(np.abs(m[at] - y[at]).mean() if absolute else np.sqrt(((m[at] - y[at]) ** 2).mean()))
    for _ in range(learner.rounds):
        history.append((loss(train), loss(np.flatnonzero(late)) if late is not None else None))
        rest = m - y
        grad = np.sign(rest) if absolute else rest
        penalty = Penalty(learner.l1, learner.l2, learner.rows)
        held = plain_tree(codes[train], grad[train], penalty, learner.leaves, learner.depth, range(codes.shape[1]))
        # Rows outside training follow by the leaf of a training row with the same codes, found again here by the tree's own rules.
        yield_ = {}
        for p, at in held.items():
            g = grad[train][at].sum(0)
            v = np.percentile(-rest[train][at], 50, axis=0, method="inverted_cdf") if absolute else -np.sign(g) * np.maximum(np.abs(g) - learner.l1, 0) / (len(at) + learner.l2)
            yield_[p] = (at, learner.rate * v)
        for at, v in yield_.values():
            m[train[at]] += v
    return m[train], history


CASES = [
    Boosting(rounds=4, rate=0.3, leaves=5, bins=8, rows=3),
    Boosting(rounds=3, rate=0.5, leaves=8, depth=2, bins=4, rows=1, l1=0.5, l2=2.0),
    Boosting(rounds=3, rate=0.4, leaves=31, bins=31, rows=5, l1=0.5, l2=0.5),
    Boosting(objective="mae", rounds=4, rate=0.5, leaves=4, bins=8, rows=4, l1=0.5, l2=0.5),
]


@pytest.mark.parametrize("learner", CASES)
@pytest.mark.parametrize("targets", [["y"], ["y", "z"]])
def test_boosting_equals_plain_trees(spark, monkeypatch, learner, targets):
    if learner.objective == "mae" and len(targets) > 1:
        with pytest.raises(ValueError):
            learner.fit(spark.createDataFrame(table(5, 0), SCHEMA), ["a"], targets)
        return
    monkeypatch.setattr(trees, "BLOCK", 17)
    monkeypatch.setattr(trees, "CUT", 2)
    rows = table(150, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = learner.fit(df, ["a", "b", "c"], targets)
    x, y, _ = arrays(rows, [SCHEMA.split(", ").index(f"{t} double") for t in targets])
    codes = model.bins.codes(list(x.T))
    want, history = plain_boosting(x, y, learner, codes)
    assert np.allclose(model.margins(list(x.T)), want)
    assert np.allclose([h["train"] for h in model.history[: learner.rounds]], [h[0] for h in history])
    got = model.predict(df.withColumn("y_hat", F.lit("old")))
    assert got.columns == ["a", "b", "c", "y", "z", "late", *[f"{t}_hat" for t in targets]] and got.count() == len(rows)
    assert math.isclose(sum(model.importance().values()), 1) and model.importance()["c"] == 0


@pytest.mark.parametrize("tasks", [1, 40])
def test_sums_merge_in_groups(spark, tasks):
    rows = table(200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (Boosting(rounds=2, leaves=4, rows=5).fit(df.repartition(k), ["a", "b"], ["y"]) for k in (1, tasks))
    x = arrays(rows, [3])[0]
    assert np.allclose(one.margins(list(x[:, :2].T)), many.margins(list(x[:, :2].T)))


def test_a_horizon_in_one_model(spark):
    r = random.Random(3)
    rows = [(float(k := r.randrange(12)), *[math.sin(k + h) + r.gauss(0, 0.01) for h in range(24)]) for _ in range(400)]
    names = [f"y{h}" for h in range(24)]
    df = spark.createDataFrame(rows, "a double, " + ", ".join(f"{n} double" for n in names))
    model = Boosting(rounds=12, rate=0.5, leaves=12, rows=1).fit(df, ["a"], names)
    assert len(model.trees) == 12 and len(model.trees[0].value[0]) == 24
    got = model.predict(df).limit(20).collect()
    assert max(abs(g[f"{n}_hat"] - math.sin(g.a + h)) for g in got for h, n in enumerate(names)) < 0.1


def test_early_stopping(spark):
    rows = table(300, 4, holes=False)
    rng = random.Random(5)
    rows = [(*r[:3], r[3] + rng.gauss(0, 2), *r[4:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = Boosting(rounds=14, rate=0.7, leaves=8, rows=2).fit(df, ["a", "b"], ["y"], F.col("late"))
    losses = [h["valid"] for h in whole.history]
    assert len(losses) == 15 and len(whole.trees) == losses.index(min(losses)) < 14
    early = Boosting(rounds=14, rate=0.7, leaves=8, rows=2, patience=3).fit(df, ["a", "b"], ["y"], F.col("late"))
    assert early.history == whole.history[: len(early.history)] and len(early.trees) == len(whole.trees) and len(early.history) == len(whole.trees) + 4
    x, y, late = arrays(rows, [3])
    m = early.margins(list(x[:, :2].T))
    assert math.isclose(math.sqrt(((m - y)[late] ** 2).mean()), min(losses), rel_tol=1e-9)


def test_samples(spark):
    df = spark.createDataFrame(table(400, 6), SCHEMA)
    learner = Boosting(rounds=3, leaves=4, rows=2, row_share=0.8, feature_share=0.5)
    a, b = (learner.fit(df.repartition(k), ["a", "b"], ["y"]) for k in (1, 5))
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and len({f for t in a.trees for f in t.feature}) == 3
    used = [{f for f in t.feature if f >= 0} for t in a.trees]
    assert all(len(u) == 1 for u in used)


def test_extra_trees(spark):
    rows = table(300, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    learner = ExtraTrees(trees=10, depth=5, rows=3)
    model, again = (learner.fit(df.repartition(k), ["a", "b", "c"], ["y", "z"]) for k in (1, 6))
    assert [t.cut for t in model.trees] == [t.cut for t in again.trees] and len({tuple(t.cut) for t in model.trees}) > 5
    x, y, _ = arrays(rows, [3, 4])
    codes = model.bins.codes(list(x.T))
    for t in model.trees:
        leaf = t.nodes(codes)
        for k in set(leaf):  # whole leaves, means of their rows, no bootstrap
            assert (leaf == k).sum() >= 3 and np.allclose(t.value[k], y[leaf == k].mean(0))
    assert np.abs(model.margins(list(x.T)) - y).mean() < 0.6 * np.abs(y - y.mean(0)).mean()


def plain_ada(codes, label, rounds):
    sign, w, out = np.where(label > 0, 1, -1), np.ones(len(label)), []
    for _ in range(rounds):
        best = None
        for f in range(codes.shape[1]):
            for cut in range(int(codes.max()) + 2):
                for vote in (1, -1):
                    e = w[np.where(codes[:, f] <= cut, vote, -vote) != sign].sum() / w.sum()
                    if best is None or e < best[0] - 1e-10:
                        best = (e, f, cut, vote)
        e, f, cut, vote = best
        if e >= 0.5 - 1e-12:
            break
        a = 0.5 * math.log((1 - max(e, 1e-10)) / max(e, 1e-10))
        out.append((f, e, a))
        w = w * np.exp(-a * sign * np.where(codes[:, f] <= cut, vote, -vote))
        if e <= 1e-10:
            break
    return out


def test_adaboost(spark):
    r = random.Random(8)
    rows = [(float(r.randrange(6)), r.gauss(0, 1), float(r.random() < 0.5)) for _ in range(80)]
    rows = [(None if i % 9 == 0 else a, b, float((a + b > 3) != (i % 10 == 0))) for i, (a, b, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    model = AdaBoost(rounds=8).fit(df.repartition(4), ["a", "b"], "label")
    x = np.array([[np.nan if v is None else v for v in r[:2]] for r in rows])
    want = plain_ada(model.bins.codes(list(x.T)), np.array([r[2] for r in rows]), 8)
    assert [s[0] for s in model.stumps] == [w[0] for w in want] and np.allclose([s[3] for s in model.stumps], [w[2] for w in want]) and np.allclose(model.history, [w[1] for w in want])
    got = model.predict(df)
    assert got.filter("prediction = label").count() > 60 and got.filter("probability > 0.5").count() == got.filter("prediction = 1").count()
    apart = AdaBoost().fit(df.withColumn("label", (F.coalesce("a", F.lit(0.0)) > 2).cast("double")), ["a"], "label")
    assert len(apart.stumps) == 1 and apart.history[0] == 0
    assert AdaBoost().fit(df.limit(0), ["a"], "label").stumps == []


def test_empty_and_constant(spark, tmp_path):
    df = spark.createDataFrame(table(30, 9), SCHEMA)
    for learner in (Boosting(rounds=3), ExtraTrees(trees=2)):
        none = learner.fit(df.limit(0), ["a"], ["y"])
        assert none.predict(df).filter("y_hat = 0").count() == df.count()
        flat = learner.fit(df, ["c"], ["y"])
        mean = df.agg(F.avg("y")).first()[0]
        assert flat.predict(df).filter(F.abs(F.col("y_hat") - mean) < 1e-9).count() == df.count()
    assert none.predict(df.limit(0)).count() == 0
    model = Boosting(rounds=2, leaves=3, rows=2).fit(df, ["a", "b"], ["y"], F.col("late"))
    ada = AdaBoost(rounds=2).fit(df.withColumn("l", (F.col("b") > 0).cast("int")), ["b"], "l")
    for m in (model, ada):
        trees.save(m, spark, str(tmp_path / "m"))
        back = trees.load(spark, str(tmp_path / "m"))
        assert back.predict(df).drop("late").fillna(-1).collect() == m.predict(df).drop("late").fillna(-1).collect() and back.importance() == m.importance()
    with pytest.raises(ValueError):
        Boosting(objective="other").fit(df, ["a"], ["y"])


def test_a_batch_of_blocks_is_bounded(spark, monkeypatch):
    """Every pass of a fit runs with small Arrow batches, which are read without a copy; the session's limit is as before."""
    import tracemalloc

    import pyarrow as pa

    name, seen, whole = "spark.sql.execution.arrow.maxBytesPerBatch", [], trees._pass
    monkeypatch.setattr(trees, "_pass", lambda *a: seen.append(int(spark.conf.get(name).removesuffix("b"))) or whole(*a))
    before = spark.conf.get(name)
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 2) for i in range(200)], "a double, y double, label int")
    trees.Boosting(rounds=2, rows=1).fit(df, ["a"], ["y"])
    trees.ExtraTrees(trees=1, depth=2).fit(df, ["a"], ["y"])
    trees.AdaBoost(rounds=2).fit(df, ["a"], "label")
    assert seen and max(seen) <= 8 << 20 and spark.conf.get(name) == before
    n = trees.BLOCK
    one = trees._block(False, np.arange(n), np.zeros((n, 5), np.uint8), np.ones((n, 1)), np.zeros((n, 1)))
    batch = pa.Table.from_batches([one] * 16).combine_chunks().to_batches()[0]
    tracemalloc.start()
    rows = sum(len(k) for _, k, *_ in trees._opened([batch], 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 16 * n and peak < batch.nbytes / 16


def test_boosting_l1_fits_all_rounds(spark, sf, monkeypatch):
    """The query leaves the learner's 1000 rounds and its rate as they are."""
    from chronoloom.catalog import QUERIES
    from chronoloom.plans import learners

    seen = []

    def fit(self, df, features, targets, valid=None):
        seen.append(self.params())
        return trees.TreeModel(trees.Bins(list(features), [np.zeros(0)] * len(features)), list(targets), [0.0], [])

    monkeypatch.setattr(Boosting, "fit", fit)
    assert QUERIES["boosting_l1"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert seen == [learners.create("lgb").params()] and seen[0]["rounds"] == 1000 and seen[0]["rate"] == 0.05


def test_absolute_loss_by_cells(spark, monkeypatch):
    """Pairs of features or single ones, medians by bins alone, few or many parts: the same trees; samples and a held-out part keep their rows apart."""
    rows = table(400, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    learner = Boosting(objective="mae", rounds=5, rate=0.5, leaves=6, bins=8, rows=3, l1=0.5, l2=0.5, row_share=0.8, feature_share=0.7)
    want = learner.fit(df, ["a", "b", "c"], ["y"], F.col("late"))
    monkeypatch.setattr(trees, "BLOCK", 13)
    monkeypatch.setattr(trees, "CUT", 2)
    monkeypatch.setattr(trees, "PAIRS", 0)
    monkeypatch.setattr(trees, "MEDIAN_LEFT", 0)
    got = learner.fit(df.repartition(5), ["a", "b", "c"], ["y"], F.col("late"))
    assert [vars(t) for t in got.trees] == [vars(t) for t in want.trees] and np.allclose([h["valid"] for h in got.history], [h["valid"] for h in want.history])
    x, y, late = arrays(rows, [3])
    codes = want.bins.codes(list(x.T))
    m = np.full(len(y), want.start[0])
    for t, h in zip(want.trees, want.history, strict=False):
        assert math.isclose(np.abs(m - y[:, 0])[~late].mean(), h["train"]) and math.isclose(np.abs(m - y[:, 0])[late].mean(), h["valid"])
        m = m + t.values(codes)[:, 0]
    flat = spark.createDataFrame([(float(i % 3), 5.0 if i % 4 else math.inf) for i in range(60)], "a double, y double")
    learner = Boosting(objective="mae", rounds=3, rows=1)
    assert learner.fit(flat, ["a"], ["y"]).predict(flat).filter("y_hat = 5").count() == 60
    assert learner.fit(flat.limit(0), ["a"], ["y"]).trees == []
    whole = spark.createDataFrame([(float(i % 2), math.inf if i % 2 else 1.0) for i in range(60)], "a double, y double")
    assert learner.fit(whole, ["a"], ["y"]).history[-1]["train"] in (0, math.inf)


@pytest.mark.parametrize("leaves", [1, 2, 31, 64, 90])
def test_lookup_equals_walking_the_tree(leaves):
    r = random.Random(leaves)
    tree, open_ = trees.Tree(), [0]
    while len(open_) < leaves:
        node = open_.pop(r.randrange(len(open_)))
        open_ += tree.split(node, r.randrange(3), r.randrange(1, 32), r.random() < 0.5, 1.0)
    codes = np.random.default_rng(leaves).integers(0, 33, (500, 3)).astype(np.uint8)
    given = np.arange(len(tree.feature))
    assert (trees.Lookup(tree, given, 33)(np.ascontiguousarray(codes.T)) == tree.nodes(codes)).all()

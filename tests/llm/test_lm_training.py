"""What the language model may learn from, large counts, and repeated rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from chronoloom.llm import lmscore


def test_held_out_texts_change_nothing_but_their_own_scores(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(120)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    other = [(i, "quite another text" if i in held else t) for i, t in rows]
    a, b = ({x.doc_id: x for x in lmscore.score(spark.createDataFrame(rs, "doc_id long, text string")).collect()} for rs in (rows, other))
    assert held and all(a[i] == b[i] for i in a if i not in held) and all(a[i].train_tokens == b[i].train_tokens for i in a)


def test_counts_beyond_32_bits():
    key = lmscore.pack(np.array([7], np.uint64))
    rows = [(0, k, kind, key, lmscore.pack(np.array([3_000_000_000], np.uint32))) for k in range(3) for kind in (lmscore.WORDS, lmscore.BIGRAMS)]
    cols = list(zip(*rows, strict=True))
    t = pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.int32()), "keys": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})
    out = lmscore._answers(t).to_pylist()
    assert next(x for x in out if x["block"] == -1)["n"] == 9_000_000_000
    assert all(lmscore.unpack(x["totals"], np.uint64).tolist() == [9_000_000_000] for x in out if x["block"] >= 0)


def test_repeated_rows_are_dealt_over_blocks(spark, monkeypatch):
    sizes = []
    seen = lmscore._requests
    df = spark.createDataFrame([(1, "one text " * 50)] * 400, "doc_id long, text string")
    monkeypatch.setattr(lmscore, "_requests", lambda block, texts, train, buckets: sizes.append(len(texts)) or seen(block, texts, train, buckets))
    got = lmscore.score(df, block_bytes=20_000).collect()
    assert len(got) == 400 and len({(x.n_tokens, x.train_tokens, round(x.score, 6)) for x in got}) == 1
    assert df.selectExpr("pmod(xxhash64(doc_id, text, monotonically_increasing_id()), 8) b").groupBy("b").count().selectExpr("max(count)").first()[0] < 100


def test_states_follow_failure_arcs():
    b = lmscore.Block(["a b", "a c", "z a"], np.array([True, True, False]))
    *_, score = b.traverse(b.counts, 6, 4, lmscore.MU)
    p = lambda c: (c + 0.1) / (6 + 0.5)
    back = lambda c: lmscore.FLOOR + (1 - lmscore.FLOOR) * lmscore.MU / (c + lmscore.MU)
    arc = lambda c2, c, w: (1 - lmscore.FLOOR) * c2 / (c + lmscore.MU) + back(c) * w
    # Start -> z fails; z was never seen and fails with weight one; a -> end fails.
    want = np.log10([back(2) * p(0), back(0) * p(2), back(2) * p(2)]).sum()
    assert np.isclose(score[2], want)
    assert np.isclose(score[0], np.log10([arc(2, 2, p(2)), arc(1, 2, p(1)), arc(1, 1, p(2))]).sum())

"""The near-dedup stage links by SimHash first; every link is verified, and MinHash completes the rest."""

import random

import corpus_pipeline
from chronoloom.llm import nearjaccard, simhash


def test_simhash_links_without_a_bucket(spark, monkeypatch):
    r = random.Random(6)
    texts = []
    for _ in range(8):
        base = [f"w{r.randrange(5000)}" for _ in range(900)]
        texts += [" ".join(base), " ".join([*base[:-1], "end"])]
    for tail in ("x", "y"):  # alike in their repeated words only: one phrase outweighs tails that differ
        texts.append("one two three " * 300 + " ".join(f"{tail}{k}" for k in range(40)))

    def bits(i, j):
        return (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count()

    linked = [i for i in range(0, 16, 2) if bits(i, i + 1) <= simhash.BUDGET]
    assert len(linked) >= 6 and bits(16, 17) <= simhash.BUDGET
    want = set(range(18)) - {i + 1 for i in linked}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    buckets = nearjaccard._buckets
    monkeypatch.setattr(nearjaccard, "_buckets", lambda codes: buckets(codes).limit(0))
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want

"""The near-dedup stage against brute force over all pairs."""

import random
from collections import Counter

import corpus_pipeline
from chronoloom.llm import nearjaccard, simhash


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y)


def test_stage_finds_all_similar_texts(spark):
    r = random.Random(4)
    texts = ["", "  \n", "one two", "One TWO", "one two three"]
    for size in (60, 120, 300):
        for _ in range(12):
            base = words(r, size)
            texts.append(" ".join(base))
            for cut in (0.05, 0.1, 0.13, 0.2, 0.3):  # kept in one piece: similarity 1 - cut and below 0.8
                texts.append(" ".join(base[: int(size * (1 - cut))]))
    hub = words(r, 200)
    for _ in range(60):  # one large group whose copies differ from each other
        copy = list(hub)
        copy[r.randrange(200)] = f"c{r.randrange(10**6)}"
        copy[r.randrange(200)] = f"c{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(7, texts[7])]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    wide, sets = 0, list(map(shingles, texts))
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
                wide += bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") > simhash.BUDGET
    assert wide > 20  # pairs that three bits of a SimHash do not link
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(find(i) for i in range(len(texts)))
    assert Counter(x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == Counter(want.keys())
    assert {(x.doc_id, x.component_id) for x in nearjaccard.near_groups(docs).collect()} == {(i, find(i)) for i in range(len(texts))}
    assert nearjaccard.keep_one(docs.limit(0)).count() == 0

"""The inferred formats against values they have not seen, and their spans against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import secrets

HEX, KEY = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VOWELS, REST = "aeiou", "bcdfghlmnprstvz"


def drawn(r, chars, n):
    return "".join(r.choice(chars) for _ in range(n))


def word(r):
    return "".join(r.choice(REST) + r.choice(VOWELS) for _ in range(r.randrange(1, 16)))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    rows = []
    for i in range(600):
        text = [word(r) for _ in range(60)]
        if i % 3 == 0:
            text.insert(20, f"password={drawn(r, HEX, 18)}")
        if i % 3 == 1:
            text.insert(30, "AKIA" + drawn(r, KEY, 16))
        rows.append((i, " ".join(text)))
    loose = [drawn(r, HEX, 18) for _ in range(40)] + ["ASIA" + drawn(r, KEY, 16) for _ in range(40)]
    rows += [(1000 + i, f"{word(r)} {v} {word(r)} {v}") for i, v in enumerate(loose)]  # each twice: repeated spans
    rows += [(2000, " ".join(word(r) for _ in range(60_000)) + " " + loose[0]), (2001, None), (2002, ""), (2003, "x" * 300_000), (2004, "token=" + "Ab1/" * 5000)]
    return rows, loose


@pytest.fixture(scope="module")
def formats(spark, corpus):
    return secrets.learn(spark.createDataFrame(corpus[0], "doc_id long, text string").repartition(37))


def test_states_follow_the_formats(formats):
    assert formats.automata["access"].states == 21  # one for each character read


def test_unlabelled_values_are_found(spark, corpus, formats):
    rows, loose = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.find_secrets(docs, formats).collect()}
    found = 0
    for i, v in enumerate(loose):
        text = rows[600 + i][1]
        assert not secrets.base_spans(text)
        at = [f"format:{m.start()}:{m.end()}" for m in re.finditer(v, text)]
        found += got[1000 + i] == ",".join(at)
    assert found >= 0.9 * len(loose)
    assert not any("format" in got[i] for i in range(600)) and got[2003] == ""
    assert got[2000].count("format") == 1  # at the end of a long text


def slow_odds(f, counts, value):
    """From the counts alone, character by character."""
    n = counts.reshape((secrets.SYMBOLS,) * 3).astype(float)
    single = n.sum((0, 1)) + 1
    single /= single.sum()
    x = [secrets.ALPHABET.index(c) + 1 for c in value]
    plain = 0.0
    for i, c in enumerate(x):
        seen = n.sum(0)[0] if i == 0 else n[0 if i == 1 else x[i - 2], x[i - 1]]
        plain += math.log((seen[c] + 5 * single[c]) / (seen.sum() + 5))
    best = -math.inf
    for kind, a in f.automata.items():
        s, total = 0, 0.0
        for c in value:
            k = secrets._OF[c]
            total -= math.log(len(secrets._CLASSES[k]))
            total += math.log(0.01 / (len(secrets._CLASSES) + 2)) if s is None else a.out[s].get(k, a.out[s][None])
            s = None if s is None else a.arcs[s].get(k)
        total += math.log(0.01 / (len(secrets._CLASSES) + 2)) if s is None else a.out[s].get(-1, a.out[s][None])
        if total >= f.floor[kind] * len(value):
            best = max(best, total)
    return best - plain


def test_spans_are_those_of_brute_force():
    r = random.Random(3)
    text = " ".join(word(r) for _ in range(4000))
    counts = secrets.triples([text])
    symbols = np.concatenate(([0], [secrets.ALPHABET.find(c) + 1 for c in text], [0]))
    assert Counter(zip(*(symbols[k : len(symbols) - 2 + k].tolist() for k in range(3)), strict=True)) == {tuple(int(v) for v in np.unravel_index(i, (secrets.SYMBOLS,) * 3)): int(counts[i]) for i in np.flatnonzero(counts)}
    f = secrets.Formats({"hex": [drawn(r, HEX, 32) for _ in range(150)], "access": ["AKIA" + drawn(r, KEY, 16) for _ in range(150)]}, counts)
    pieces = [word(r) for _ in range(300)] + [drawn(r, HEX, n) for n in (8, 20, 22, 23) for _ in range(8)] + ["BKIA" + drawn(r, KEY, n) for n in (4, 12, 16, 17) for _ in range(8)] + [drawn(r, KEY + HEX, n) for n in range(4, 40)]
    r.shuffle(pieces)
    probe = " ".join(pieces)
    base = secrets.base_spans(probe)
    want = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", probe):
        if len(m[0]) >= f.least and not any(m.start() < e and s < m.end() for s, e, *_ in base):
            if slow_odds(f, counts, m[0]) >= max(secrets.IN_ALL, secrets.PER_CHAR * len(m[0])):
                want.append((*m.span(), "format"))
    got = [x for x in secrets.scan(probe, f)[1] if x[2] == "format"]
    assert got == want and len(want) >= 8


def test_sample_is_that_of_the_smallest_hashes(spark):
    r = random.Random(8)
    rows = [(k, drawn(r, HEX, 12), r.randrange(10**6)) for k in ("a", "b") for _ in range(900)]
    df = spark.createDataFrame(rows + rows[:50], "kind string, value string, h long").repartition(40)
    got = sorted((x.kind, x.h, x.value) for x in secrets._sampled(df, 25).collect())
    assert got == sorted(x for k in ("a", "b") for x in sorted((k, h, v) for kk, v, h in rows if kk == k)[:25])


def test_long_hits_take_linear_time():
    many = " ".join(["a" * 3 + "0" * 30] * 20_000)
    assert len(secrets.scan(many, secrets.Formats({}, np.zeros(secrets.SYMBOLS**3, np.int64)))[0]) == 20_000
    assert len(secrets.candidates(many, secrets.base_spans(many))) == 0

"""Spelling variants against all pairs, and the defined results of odd rows."""

import random
import zlib
from collections import Counter

import pytest

from chronoloom.llm import spelling

SCHEMA = "doc_id long, text string"


def edits(a, b):
    """Whether two words differ by exactly one edit."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if edits(w, x)]
        best = min(near, default=None)
        out[w] = (best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None), len(near)
    root = {}
    for w in counts:
        r = w
        while out[r][0][0]:
            r = out[r][0][0]
        root[w] = r
    return {(w, f, root[w], counts[w], k, m) for w, ((f, m), k) in out.items()}


def vocabulary(seed, letters, lengths, size):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(size)}
    for w in sorted(words)[: size // 2]:  # chains of edits, at both ends and inside
        for _ in range(4):
            k, c = r.choice([0, 1, len(w) // 2, len(w) - 1, len(w)]), r.choice(letters)
            w = r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.add(w)
    return sorted(w for w in words if len(w) >= 4)


@pytest.mark.parametrize(("letters", "lengths"), [("ab", [4, 5, 6, 7, 8]), ("abcdeéñÿ", [7, 8, 9]), ("a", range(4, 30)), ("ab", [63, 64, 65, 66, 90]), ("xyzÀ×", [4, 5, 12, 40])])
def test_all_near_pairs(spark, letters, lengths):
    words = vocabulary(3, letters, list(lengths), 250)
    df = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long").repartition(5)
    rows = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    assert len(rows) == len(set(rows)) == len({frozenset(x) for x in rows})
    assert {frozenset(x) for x in rows} == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if edits(a, b)}


def counted(rows):
    import re

    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_whole_texts(spark):
    r = random.Random(5)
    base = vocabulary(9, "abcdefgÉé", [7, 8, 9, 10], 60)
    rows = [(i, " ".join(r.choices([w.title() for w in base], [1000 if k % 9 == 0 else 3 for k in range(len(base))], k=80)) + (" Überraschung, ÜBERRASCHUNG überraschung" if i % 2 else "")) for i in range(80)]
    rows += [rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "12 -- 七七七七七七七"), (903, "q" * 100_000 + " " + "q" * 99_999), (904, "q" * 100_000 + "!" + "q" * 99_999)]
    got = spelling.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "'w' word", "1 n", "2 p", "3 k"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(set(got)) and set(got) == expected(counted(rows))
    assert any(f and root != f for _, f, root, *_ in got) or any(f for _, f, *_ in got)


def test_chains_end_at_the_last_form(spark):
    steps = [("aaaaaaa", 3), ("aaaaaab", 40), ("aaaaabb", 500), ("aaaabbb", 6000), ("aaabbbb", 70_000), ("zzzzzzz", 7), ("zzzzzzy", 70), ("zzzzzyz", 70)]
    words = spark.createDataFrame(steps, "word string, n long")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.roots(spelling.forms(words, spelling.near_pairs(words))).collect()}
    assert got == expected(dict(steps)) and ("aaaaaaa", "aaaaaab", "aaabbbb", 3, 1, 40) in got and ("zzzzzzz", "zzzzzyz", "zzzzzyz", 7, 2, 70) in got


def test_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        assert spelling.group_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="four"):
        spelling.group_variants(spark.createDataFrame([], SCHEMA), least=3)

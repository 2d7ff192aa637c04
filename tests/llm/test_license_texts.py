"""Known licences inside longer texts, against plain Python."""

import re

from chronoloom.llm import licenses


def canonical(t):
    x = (t or "").lower()
    for a, b in licenses.SPELLINGS:
        x = x.replace(a, b)
    x = re.sub(licenses.CLAIM, " ", x)
    return " ".join("".join(c if c.isalnum() else " " for c in x).split())


def want(t, known):
    w = canonical(t).split()
    ends, ids = set(), set()
    for k, x in known:
        n = len(x)
        for i in range(len(w) - n + 1):
            if n < len(w) and w[i : i + n] == x:
                ends.add(i + n)
                ids.add(k)
    return len(ends), sorted(ids)


def test_licences_inside_texts(spark):
    texts = dict(enumerate(t for _, t in licenses.KNOWN))
    isc = licenses._ISC.replace("copyright notice and", "\ncopyright notice and")  # a line that starts with the word
    rows = [(k, t) for k, t in texts.items()]
    rows += [(100 + k, f"import os\n# Copyright 2021 A. Person\n{t}\n\nprint(1) {t}") for k, t in texts.items()]
    rows += [(200, "Copyright (c) 2019 B\n" + isc), (201, "code\n" + isc.replace(". ", ".\n// ")), (202, None), (203, ""), (204, "word " * 20_000 + licenses._MIT + " tail" * 20_000)]
    rows += [(205, "Released under the MIT License. Released under the MIT Licence."), (206, "released under the mit"), (207, "Some project is free.\n(c) 2020"), (205, "Released under the MIT License. Released under the MIT Licence.")]
    rows += [(208, "My OWN\nterms, all rights reserved - see there"), (209, "my own terms all rights reserved")]
    more = spark.createDataFrame([("OWN", "My own terms. All rights reserved."), ("ALSO", "my own terms, all rights reserved")], "license_id string, text string")
    known = {canonical(t): k for k, t in [*licenses.KNOWN, ("ALSO", "My own terms. All rights reserved.")]}
    split = [(k, x.split()) for x, k in known.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (licenses.BEGINNINGS, 0):
        old, licenses.BEGINNINGS = licenses.BEGINNINGS, most
        try:
            got = sorted((r.doc_id, r.license_id, r.n_notices, list(r.notices)) for r in licenses.scan(df, licenses.catalogue(spark, more)).collect())
        finally:
            licenses.BEGINNINGS = old
        assert got == sorted((i, known.get(canonical(t)), *want(t, split)) for i, t in rows)
    by = {r[0]: r for r in got}
    assert by[200][1] == "ISC" and by[201][3] == ["0BSD", "ISC"][1:] and by[204][3] == ["MIT"] and by[205][2] == 2 and by[209][1] == "ALSO"

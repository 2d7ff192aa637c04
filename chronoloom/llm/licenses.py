"""License scans: canonical digests of entire texts looked up among known ones.

A text is brought to canonical form (case, equivalent spellings, copyright lines,
punctuation and white space), its SHA-256 is hash-joined to the digests of known licence
texts.  Known texts are looked up inside other texts as well: wherever the first word of
one stands, the digest of as many words as the known text has is joined in the same way.
Where a catalogue has few beginnings (the first words of its texts), texts that contain
none of them are passed over; the result is the same.

The catalogue holds the texts below; ``catalogue`` takes further (license_id, text) rows.

Defined results: null and empty texts match nothing; of licences with one canonical form
the smallest id is reported; a known text inside a longer known one that ends where it
ends counts once, with both ids; the whole text is no notice in itself; repeated rows
each give a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, require, small

#: Equivalent spellings, each replaced by the second.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("whilst", "while"),
    ("https:", "http:"),
)

#: A line that claims a copyright: with a sign or a year, so that no line of a licence that merely speaks of copyright goes.
CLAIM = r"(?m)^[^a-z0-9\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"
#: First words that a beginning has, and beginnings up to which texts are searched for them first.
BEGIN, BEGINNINGS = 5, 64

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_0BSD = _ISC.split(", provided that")[0] + ".\n" + _ISC.split("\n")[1]
_MIT0 = _MIT.split(", subject to the following")[0] + ".\n" + _MIT.split("\n")[2]
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
#: Known licence texts and notices, by SPDX id.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD3 + _BSD_END),
    ("0BSD", _0BSD),
    ("MIT-0", _MIT0),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
)


def canonical(text: Column) -> Column:
    x = F.lower(text)
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    # Lines that claim a copyright; most texts have none and skip the pattern.
    line = F.regexp_replace(x, CLAIM, " ")
    x = F.when(x.contains("copyright") | x.contains("(c)") | x.contains("©"), line).otherwise(x)
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(license_id, digest, n, first, beginning), one id for each digest; texts without a word are left out."""
    known = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    if more is not None:
        require(more, "license_id", "text")
        known = known.unionByName(more.select("license_id", "text"))
    known = known.select("license_id", canonical(F.col("text")).alias("x")).filter(F.length("x") > 0)
    known = known.groupBy("x").agg(F.min("license_id").alias("license_id"))
    w = F.split("x", " ")
    return known.select("license_id", F.sha2("x", 256).alias("digest"), F.size(w).alias("n"), w[0].alias("first"), F.array_join(F.slice(w, 1, BEGIN), " ").alias("beginning"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), n_notices (ends of known texts inside it), notices (their ids, distinct and sorted) for each row."""
    require(docs, "doc_id", "text")
    known = durable(known)
    size = known.count()
    begins = [r[0] for r in known.select("beginning").distinct().limit(BEGINNINGS + 1).collect()]
    x = canonical(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", x.alias("x"), F.monotonically_increasing_id().alias("_row"))
    # An empty list of words where no known text can stand.
    there = reduce(Column.__or__, [F.col("x").contains(b) for b in begins], F.lit(False)) if len(begins) <= BEGINNINGS else F.lit(True)
    rows = rows.select("_row", "doc_id", F.sha2("x", 256).alias("digest"), F.when(there, F.split("x", " ")).alias("w"))
    rows = rows.withColumn("at", F.explode_outer(F.sequence(F.lit(1), F.size("w"))))
    first = known.select("first", F.col("n").alias("long")).groupBy("first").agg(F.collect_set("long").alias("longs"))
    # A row for each position where a known text may start, and position 1 of each document in any case.
    rows = rows.withColumn("word", F.expr("w[at - 1]")).join(small(first, size, 160), F.col("word") == F.col("first"), "left")
    rows = rows.filter(F.coalesce(F.col("at"), F.lit(1)).eqNullSafe(F.lit(1)) | F.col("longs").isNotNull()).withColumn("long", F.explode_outer("longs"))
    fits = (F.col("at") + F.col("long") - 1 <= F.size("w")) & (F.col("long") < F.size("w"))
    rows = rows.withColumn("_inside", F.when(fits, F.sha2(F.array_join(F.slice("w", F.col("at"), F.col("long")), " "), 256)))
    inside = small(known.select(F.col("digest").alias("_inside"), F.col("license_id").alias("notice")), size, 160)
    rows = rows.select("_row", "doc_id", "digest", "_inside", (F.col("at") + F.col("long")).alias("end")).join(inside, "_inside", "left")
    rows = rows.groupBy("_row", "doc_id", "digest").agg(F.size(F.collect_set(F.when(F.col("notice").isNotNull(), F.col("end")))).cast("long").alias("n_notices"), F.array_sort(F.collect_set("notice")).alias("notices"))
    return rows.join(small(known.select("digest", "license_id"), size, 160), "digest", "left").select("doc_id", "digest", "license_id", "n_notices", "notices")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), catalogue(spark))
    return found.select("doc_id", "digest", "license_id", "n_notices", F.concat_ws(",", "notices").alias("notices"))


def _canonical_sql(x: str) -> str:
    x = f"lower({x})"
    for old, new in SPELLINGS:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace({x}, '{CLAIM}', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def op2_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH k AS (SELECT x, sha256(x) AS digest, string_split(x, ' ') AS w, min(id) AS license_id FROM (SELECT id, {_canonical_sql("text")} AS x FROM (VALUES {rows}) AS v(id, text)) GROUP BY x),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql("coalesce(text, '')")} AS x FROM documents),
t AS (SELECT r, string_split(x, ' ') AS w FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t),
h AS (SELECT p.r, p.i + len(k.w) AS stop, k.license_id FROM p JOIN k ON p.w[p.i] = k.w[1] AND len(k.w) < len(p.w) AND p.w[p.i : p.i + len(k.w) - 1] = k.w),
n AS (SELECT r, count(DISTINCT stop) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM h GROUP BY r)
SELECT d.doc_id, sha256(d.x) AS digest, k.license_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.ids, '') AS notices
FROM d LEFT JOIN k ON d.x = k.x LEFT JOIN n ON d.r = n.r
"""

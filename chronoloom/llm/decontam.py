"""Benchmark decontamination: a broadcast hash set of benchmark n-grams meets document windows.

Every benchmark item yields its windows of ``n`` consecutive words (an item of fewer
words, but at least one, is a single window).  Documents are tokenised once; their
windows are streamed through a hash join with the n-gram table, and each hash hit is
verified on the words themselves.  All of it is built-in expressions.  A table of n-grams
too large to broadcast sends its hashes alone ahead, and only windows whose hash it has are
shuffled for verification; if even the hashes are too many, all windows are, each with its
own words only.

Defined results: a null or wordless text has no words and no hits; null items and
wordless items have no windows; an item without id marks words but is not listed;
repeated items count once; repeated document rows each give a row; empty tables give
empty or hit-free results; further columns, whatever their names, are ignored by
``find_leaks`` and kept by ``drop_leaks`` and ``cut_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_BYTES, durable, fold_case, fresh, require, small

N = 10
#: Bytes that a broadcast hash takes.
HASH_BYTES = 16
#: All ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One such character of a text whose case is not folded.
UNFOLDED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    return F.filter(F.split(fold_case(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def benchmark_grams(bench: DataFrame, n: int = N) -> DataFrame:
    """(gram, len, gh, item_id): the distinct windows of all items."""
    require(bench, "item_id", "text")
    w = bench.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    grams = w.select("item_id", "w", starts.alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("gram"))
    return grams.distinct().select("item_id", "gram", F.size("gram").alias("len"), F.xxhash64("gram").alias("gh"))


def _hits(docs: DataFrame, bench: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows (keys, n_words, pos, len, item_id, hit): one with pos 0 for each document, and one for each verified hit."""
    grams = durable(benchmark_grams(bench, n))
    count, longest = grams.agg(F.count("*"), F.max(F.expr("aggregate(gram, 0L, (a, x) -> a + octet_length(x))"))).first()
    lengths = [r[0] for r in grams.select("len").distinct().collect()] or [n]  # at most n values
    whole = count * ((longest or 0) + 16 * n + 64) <= BROADCAST_BYTES
    w = docs.select(*keys, words(F.col("text")).alias("_w")).withColumn("n_words", F.size("_w"))
    w = w.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - min(lengths) + 1, F.lit(0)))))
    if len(lengths) == 1:
        w = w.withColumn("_l", F.lit(lengths[0]))
    else:  # short items bring windows of their own lengths
        w = w.withColumn("_l", F.explode(F.when(F.col("pos") > 0, F.array(*map(F.lit, sorted(lengths)))).otherwise(F.array(F.lit(0)))))
        w = w.filter((F.col("pos") == 0) | (F.col("pos") + F.col("_l") - 1 <= F.col("n_words")))
    window = F.slice("_w", F.col("pos"), F.col("_l"))
    w = w.withColumn("_h", F.when(F.col("pos") > 0, F.xxhash64(window)))
    if whole:
        on = (F.col("_h") == grams["gh"]) & (F.when(F.col("pos") > 0, window) == grams["gram"])
        return w.join(F.broadcast(grams), on, "left").filter((F.col("pos") == 0) | F.col("gh").isNotNull()).select(*keys, "n_words", "pos", F.col("len"), "item_id")
    rows = w.filter("pos = 0").select(*keys, "n_words", "pos", F.lit(None).cast("int").alias("len"), F.lit(None).cast(grams.schema["item_id"].dataType).alias("item_id"))
    w = w.filter("pos > 0")
    if count * HASH_BYTES <= BROADCAST_BYTES:
        w = w.join(F.broadcast(grams.select(F.col("gh").alias("_h")).distinct()), "_h", "left_semi")
    w = w.select(*keys, "n_words", "pos", "_h", window.alias("_gram"))
    hits = w.join(grams, (F.col("_h") == grams["gh"]) & (F.col("_gram") == grams["gram"]))
    return rows.union(hits.select(*keys, "n_words", "pos", "len", "item_id"))


def _covered(spans: Column) -> Column:
    """Words inside the union of the (pos, len) spans, sorted by pos."""
    state = F.struct(F.lit(0).alias("n"), F.lit(1).alias("next"))

    def step(a: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["next"], s["pos"]), F.lit(0))).alias("n"), F.greatest(a["next"], end).alias("next"))

    return F.aggregate(spans, state, step, lambda a: a["n"])


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of ids as strings, sorted), spans (array of pos from 1, len) per document row."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    hits = _hits(rows, bench, n, ["_row", "doc_id"])
    found = hits.groupBy("_row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    spans = F.array_sort("spans")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(spans).cast("long").alias("n_hit"), "items", spans.alias("spans"))


def drop_leaks(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    require(docs, "doc_id", "text")
    leak_id, leak_th = fresh(docs, "_leak_id"), fresh(docs, "_leak_th")
    keyed = docs.withColumns({leak_id: F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), leak_th: F.xxhash64("text")})
    hits = _hits(keyed.select(F.col(leak_id).alias("_id"), F.col(leak_th).alias("_th"), "text"), bench, n, ["_id", "_th"])
    bad = durable(hits.filter("pos > 0").select(F.col("_id").alias(leak_id), F.col("_th").alias(leak_th)).distinct())
    return keyed.join(small(bad, bad.count(), 64), [leak_id, leak_th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_leaks(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """All documents and columns; words of benchmark windows, with what stands between them, are cut out of ``text``.

    Texts without a hit stay as they are, also if null.
    """
    require(docs, "doc_id", "text")
    leak_th, spans, joined = (fresh(docs, c) for c in ("_leak_th", "_leak_spans", "_leak_joined"))
    keyed = docs.withColumn(leak_th, F.xxhash64("text"))
    # Equal texts have equal hits.
    hits = _hits(keyed.select(F.col(leak_th).alias("_th"), "text"), bench, n, ["_th"]).filter("pos > 0")
    bad = durable(hits.groupBy(F.col("_th").alias(leak_th)).agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias(spans)))
    rows = keyed.join(small(bad, bad.count(), 1 << 10), leak_th, "left")
    text = F.col("text")
    # Each word and the break before it, if any, and the break at the end.
    pair = F.lit(f"(?<!{UNFOLDED})({UNFOLDED}*+)([^{UNFOLDED[1:]}+)")
    breaks, own = F.regexp_extract_all(text, pair, F.lit(1)), F.regexp_extract_all(text, pair, F.lit(2))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    tail = F.right(text, F.length(text) - size(breaks) - size(own))
    last = lambda a: F.element_at(a, -1)
    span = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    merged = F.aggregate(
        F.col(spans),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (s["pos"] <= last(a)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), span(last(a)["start"], F.greatest(last(a)["end"], s["pos"] + s["len"])))).otherwise(F.concat(a, span(s["pos"], s["pos"] + s["len"]))),
    )
    # A word inside a span goes; the break before it stays where the span begins.
    inside = lambda k, first: F.exists(F.col(joined), lambda s: (k >= s["start"] + first) & (k < s["end"]))
    kept = F.transform(own, lambda x, i: F.concat(F.when(inside(i + 1, 1), "").otherwise(F.element_at(breaks, i + 1)), F.when(inside(i + 1, 0), "").otherwise(x)))
    left = F.concat(F.array_join(kept, ""), tail)
    rows = rows.withColumn(joined, merged)
    out = [(F.when(F.col(spans).isNull(), text).otherwise(left).alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns]
    return rows.select(*out)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS gram, least(len(w), 10) AS l FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents),
p AS (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS gram FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g))),
h AS (SELECT p.doc_id, p.i, p.l, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.l = g.l),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

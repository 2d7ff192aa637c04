"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

Words are runs of Latin letters of all texts, counted before they are shuffled.  Bigrams are
ordered by their frequency among the words (``BUCKETS`` squared counts at most, whatever the
corpus), and each word is indexed by its three rarest bigrams with their positions.  One edit
destroys at most two bigrams of either word and keeps the others in order, shifted by at most
one position; so the first surviving bigram in the global order is among the three rarest of
both words, at the same distance from the beginning if the edit lies after it, from the end if
it lies before.  These limits are part of the join key, with the lengths, and so is the text
that such an edit leaves alone: the side of the bigram without the edit, and one half of the
other side.  What meets on a key is verified by edit distance inside the join.  A frequent
bigram at one position therefore never gathers its words; two words meet at most on the few
keys that all but their edit agree on.

A word's form is its near word of largest count, if that is at least ``RATIO`` times its own;
roots follow forms to the last.  Counts grow by that ratio at each step, so a chain has no
more steps than the largest count has digits, and pointer doubling needs a handful of joins.

Defined results: null, empty and letterless texts have no words; a null doc_id counts as the
empty string in the checksum; repeated rows count again; of equally frequent near words the
smallest in code-point order is the form; words of any length are compared whole; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, fold_case, require

LETTERS = "A-Za-zÀ-ÿ"
LEAST, TWICE, RATIO, EVERY = 7, 2, 10, 31
#: Bigrams indexed for each word: an edit destroys two.
RAREST = 3
#: Code points are told apart modulo this in the order of bigrams; a-z and U+00C0-U+00FF stay distinct.
BUCKETS = 159
#: Longer words are compared letter by letter up to the first that differs.
SHORT = 64


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE, every: int = EVERY) -> DataFrame:
    """(word, n): runs of at least ``least`` letters, lower-cased A-Z, that occur ``twice`` times; a run whose checksum ``every`` divides loses a letter."""
    require(docs, "doc_id", "text")
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", fold_case(F.col("run")).alias("run"))
    summed = each.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.expr("CAST(h % length(run) AS INT)")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return summed.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= twice)


def _buckets(word: str) -> Column:
    """The bucket of each bigram, in order."""
    chars, n = F.regexp_extract_all(F.col(word), F.lit("(?s)."), F.lit(0)), F.length(word) - 1
    of = lambda c: F.ascii(c) % BUCKETS
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: of(a) * BUCKETS + of(b))


def rarest(words: DataFrame) -> DataFrame:
    """``words`` with ``p``: the positions of the RAREST bigrams, rarest first by frequency, bucket and position."""
    counted = words.select(F.explode(_buckets("word")).alias("b")).groupBy("b").count()
    rank = ["0"] * BUCKETS**2
    for k, r in enumerate(sorted(counted.collect(), key=lambda r: (r["count"], r["b"]))):  # at most BUCKETS ** 2 rows
        rank[r["b"]] = str(k)
    ranks = F.split(F.lit(",".join(rank)), ",").cast("array<int>")  # a constant
    by_rank = F.array_sort(F.transform(_buckets("word"), lambda b, i: F.struct(F.get(ranks, b).alias("r"), i.alias("p"))))
    return words.withColumn("p", F.explode(F.slice(by_rank, 1, RAREST)["p"]))


def _keys(shorter: bool) -> list[Column]:
    """(k, role): the keys of a word and the bigram at ``p``, as the longer word of a pair (or one of two equally long) or as the shorter.

    All lengths are those of the longer word, ``w`` letters: ``r`` follow the bigram, ``l`` precede it there.
    """
    w = "length(word) + 1" if shorter else "length(word)"
    r, left = f"({w} - p - 2)", "(p + 1)" if shorter else "p"
    cases = [
        (f"{r} >= 1", "p", f"left(word, p + 2 + {r} div 2)"),
        (f"{r} >= 2", "p", f"left(word, p + 2), right(word, {r} - {r} div 2)"),
        (f"{left} >= 1", left, f"right(word, {w} - ({left} - {left} div 2))"),
        (f"{left} >= 2", left, f"left(word, {left} - {left} div 2), right(word, {w} - {left})"),
    ]
    return [F.struct(F.expr(f"CASE WHEN {if_} THEN xxhash64({k}, {w}, {at}, {text}) END").alias("k"), F.lit(int(shorter)).alias("role")) for k, (if_, at, text) in enumerate(cases)]


def _one_edit(a: str, b: str) -> str:
    """Whether ``a``, as long as ``b`` or a letter longer, is one edit from it: in time linear in the length, where edit distance is quadratic."""
    chars = "regexp_extract_all({}, '(?s).', 0)".format
    first = f"array_position(zip_with({chars(a)}, {chars(b)}, (x, y) -> x <=> y), false)"
    return f"CASE WHEN length({a}) <= {SHORT} THEN levenshtein({a}, {b}, 1) = 1 ELSE {a} <> {b} AND substr({a}, CAST({first} AS INT) + 1) = substr({b}, CAST({first} AS INT) + 1 - length({a}) + length({b})) END"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two of the distinct ``words`` (word, n) that differ by one inserted, deleted or replaced code point, once.

    The longer of two words needs at least four code points: then a bigram outlives the edit.
    """
    keyed = rarest(words).select("word", "n", F.explode(F.array(*_keys(False), *_keys(True))).alias("e")).select("e.k", "e.role", "word", "n").filter("k IS NOT NULL")
    one, two = keyed.alias("one"), keyed.alias("two")
    # As one condition over both sides the roles aren't filtered beneath the exchange, so both sides read one exchange.
    roles = "(2 * one.role + two.role = 1 OR (one.role + two.role = 0 AND one.word < two.word))"
    met = one.join(two, F.expr(f"one.k = two.k AND {roles} AND {_one_edit('one.word', 'two.word')}"))
    return met.select(F.col("one.word").alias("a"), F.col("one.n").alias("n_a"), F.col("two.word").alias("b"), F.col("two.n").alias("n_b")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of each of ``words``."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("x"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("x"), F.col("n_a").alias("m")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("m")).alias("m"), "x")).alias("best"))
    is_form = -F.col("best.m") >= F.col("n") * ratio
    return words.join(best, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.x")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``formed`` (word, n, form and more) with ``root``: the last of a word's forms, the word itself if it has none."""
    top = formed.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(top, ratio)) + 1
    up = durable(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        up = durable(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return formed.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``; words with one root are variants of it."""
    if least < 4:
        raise ValueError("words need at least four letters")
    own = durable(words(docs, least, twice, every))
    return roots(durable(forms(own, near_pairs(own), ratio)), ratio).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Near words meet on what is left when one letter is taken away; the checksum is CRC-32 by nibbles.
OP13_SQL = """
WITH RECURSIVE nib AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
dist AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)),
  lambda h, b: xor(xor(xor(h, b) >> 4, t[(xor(h, b) & 15) + 1]) >> 4, t[(xor(xor(h, b) >> 4, t[(xor(h, b) & 15) + 1]) & 15) + 1])), 4294967295::BIGINT) AS h FROM dist, nib),
said AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM summed),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
pair AS (SELECT DISTINCT a.word, b.word AS x, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS near, max(m) AS m FROM pair GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN (SELECT min(p.x) FROM pair p WHERE p.word = w.word AND p.m = best.m) END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
chain AS (SELECT word, word AS root FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON f.word = c.word JOIN form g ON c.root = g.word AND g.form IS NULL
"""

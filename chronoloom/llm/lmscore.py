"""Language-model scoring with a weighted backoff automaton.

States are the start state and one state per word; an explicit arc v -> w carries the
smoothed bigram log-probability, and every state's failure arc leads to the unigram
state with a weight that falls from one, for states never seen, to FLOOR:

    P(w | v) = (1 - FLOOR) c(v, w) / (c(v) + mu) + b(v) P(w),   b(v) = FLOOR + (1 - FLOOR) mu / (c(v) + mu),
    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

which sums to one for every state.  A text is read once, left to right: a step takes the
arc of the next word where the state has it, else the failure arc and the unigram state's
arc, and leads to the state of that word.  So the states of a text are known from its words,
and the steps of all texts of a block are looked up together and summed text by text.
FLOOR and mu were chosen on fold 1 of the test table sf0.1, trained on folds 2 to 9; held-out
rows had no part in it.

Neither the vocabulary nor the bigrams fit one machine, so the automaton is never
gathered.  Documents are dealt by content and position into blocks of about equal size.  Each block
sends the sorted keys of its own words and bigrams with its training counts to key
ranges; a range adds the counts of all blocks up and answers each block only where the
total differs from what the block knew.  Each block then builds the part of the
automaton its texts can reach and traverses it.

Defined results: a null text is empty and consists of the end token; rows without a
doc_id are training rows; repeated rows count and score as often as they occur; without
training rows all probabilities are those of the empty unigram model; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import FOLD, require

#: Least backoff weight and its mass in counts; folds, the first of which is held out; text bytes of a block.
FLOOR, MU, FOLDS, BLOCK_BYTES = 0.5, 3.0, 10, 12 << 20

WORDS, BIGRAMS = 0, 1


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key for each ordered pair of 64-bit keys."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    """The bytes of sorted or small integers by significance, so that the shuffle's compression finds their runs."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Block:
    """The n-grams of a set of texts: word ids of all texts in a row, and sorted keys of words and of bigrams with training counts."""

    def __init__(self, texts: list[str | None], train: np.ndarray):
        number = count()
        ids: dict[bytes, int] = {}
        end = ids.setdefault(b"", next(number))  # no word is empty

        def known(w: bytes) -> int:
            got = ids.get(w)
            if got is None:
                got = ids[w] = next(number)
            return got

        runs, size = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
            words.append(b"")
            runs.append(np.fromiter(map(known, words), np.int32, len(words)))
            size.append(len(words))
        self.size = np.array(size, np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.word = np.concatenate(runs).astype(np.int64)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.at] = end
        self.before = before
        weight = np.repeat(train.astype(np.int64), self.size)
        n = len(ids)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(map(digest, ids), np.uint64, n)
        own = np.bincount(self.word, weight, n).astype(np.uint32)
        order = np.argsort(hashes)
        pairs, self.pair = np.unique(before * n + self.word, return_inverse=True)
        self.lead, self.to = pairs // n, pairs % n
        keys = mix(hashes[self.lead], hashes[self.to])
        order2 = np.argsort(keys)
        own2 = np.bincount(self.pair, weight, len(pairs)).astype(np.uint32)
        self.order = (order, order2)
        self.keys = (hashes[order], keys[order2])
        self.counts = (own[order], own2[order2])

    def ranges(self, kind: int, buckets: int):
        """(bucket, from, to) of the key ranges that aren't empty."""
        bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
        cuts = np.append(np.searchsorted(self.keys[kind], bounds), len(self.keys[kind]))
        return [(i, int(cuts[i]), int(cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts)).tolist()]

    def traverse(self, total: tuple[np.ndarray, np.ndarray], n: int, v: int, mu: float):
        """Per text: n_tokens, n_known, base score and score, given the total counts in key order."""
        c, c2 = (np.empty(len(t), np.float64) for t in total)
        c[self.order[0]], c2[self.order[1]] = total
        with np.errstate(divide="ignore"):
            root = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))  # the unigram state's arc of each word
        weight = FLOOR + (1 - FLOOR) * mu / (c + mu)
        fail = np.log10(weight)  # each state's failure arc
        state, w = self.before, self.word
        lead, to = self.lead, self.to
        arc = np.log10((1 - FLOOR) * c2 / (c[lead] + mu) + weight[lead] * 10 ** root[to])
        step = np.where(c2[self.pair] > 0, arc[self.pair], fail[state] + root[w])
        add = lambda x: np.add.reduceat(x, self.at)
        return self.size, add((c[w] > 0).astype(np.int64)), add(root[w]), add(step)


def _requests(block: int, texts: list, train: np.ndarray, buckets: int) -> pa.Table:
    b = Block(texts, train)
    rows = [(i, block, kind, pack(b.keys[kind][lo:hi]), pack(b.counts[kind][lo:hi])) for kind in (WORDS, BIGRAMS) for i, lo, hi in b.ranges(kind, buckets)]
    cols = list(zip(*rows, strict=True))
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.int32()), "keys": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})


def _answers(t: pa.Table) -> pa.Table:
    """Total the counts of one key range, for each kind, and answer every block where they differ; block -1 carries the range's sums."""
    bucket, kinds = t.column("bucket")[0].as_py(), np.array(t.column("kind"))
    out: list[tuple] = []
    n = v = 0
    for kind in (WORDS, BIGRAMS):
        part = t.filter(pa.array(kinds == kind))
        if not part.num_rows:
            continue
        keys = [unpack(x.as_buffer(), np.uint64) for x in part.column("keys")]
        own = [unpack(x.as_buffer(), np.uint32) for x in part.column("counts")]
        whole, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(own), len(whole)).astype(np.uint64)  # exact up to 2 ** 53
        if kind == WORDS:
            n, v = int(total.sum(dtype=np.int64)), int((total > 0).sum())
        at = 0
        for block, mine in zip(part.column("block").to_pylist(), own, strict=True):
            got = total[place[at : at + len(mine)]]
            at += len(mine)
            new = np.flatnonzero(got != mine).astype(np.uint32)
            if len(new):
                out.append((block, bucket, kind, pack(new), pack(got[new]), 0, 0))
    out.append((-1, bucket, 0, b"", b"", n, v))
    cols = list(zip(*out, strict=True))
    kinds_ = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({k: pa.array(c, d) for k, c, d in zip(("block", "bucket", "kind", "at", "totals", "n", "v"), cols, kinds_, strict=True)})


def score(docs: DataFrame, mu: float = MU, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; rows of fold 0 teach nothing."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = buckets = max(parts, -(-size // block_bytes))
    rows = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(doc_id, text, monotonically_increasing_id()), {blocks}) as int)")).repartition(blocks, "block")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(t: pa.Table) -> pa.Table:
        return _requests(t.column("block")[0].as_py(), t.column("text").to_pylist(), ~np.array(t.column("held_out")), buckets)

    asked = rows.groupBy("block").applyInArrow(ask, "bucket int, block int, kind int, keys binary, counts binary")
    told = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers, "block int, bucket int, kind int, at binary, totals binary, n bigint, v bigint")
    # One row: N and V.  Both uses of the answers, and both of the rows, share their exchanges, so texts and requests are shuffled once.
    sums = told.filter("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("v"))

    def tell(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({k: pa.array([], d) for k, d in (("doc_id", t.schema.field("doc_id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        n, v = (t.column(c)[0].as_py() for c in ("n", "v"))
        held_out = np.array(t.column("held_out"))
        b = Block(t.column("text").to_pylist(), ~held_out)
        total = tuple(c.astype(np.uint64) for c in b.counts)
        starts = tuple({i: lo for i, lo, _ in b.ranges(k, buckets)} for k in (WORDS, BIGRAMS))
        for i, k, at, totals in zip(*(answers.column(c) for c in ("bucket", "kind", "at", "totals")), strict=True):
            k = k.as_py()
            total[k][starts[k][i.as_py()] + unpack(at.as_buffer(), np.uint32).astype(np.int64)] = unpack(totals.as_buffer(), np.uint64)
        tokens, known, base, own = b.traverse(total, n, v, mu)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": pa.array(held_out), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(tokens), n)), "base_score": pa.array(base), "score": pa.array(own)})

    replies = told.filter("block >= 0").select("block", "bucket", "kind", "at", "totals")
    summed = rows.join(F.broadcast(sums), how="cross")  # with that one row
    return summed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tell, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

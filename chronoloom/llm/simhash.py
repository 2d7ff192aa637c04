"""SimHash near-duplicate groups by a binary trie self-join.

Fingerprints are 64-bit SimHashes over word shingles.  Distinct fingerprints are joined
within a Hamming budget: by the pigeonhole principle two codes with at most ``budget``
differing bits agree on one of ``budget + 1`` blocks, so for each block the codes are
rotated to start with it and dealt out by its value.  Each partition then holds whole
subtries; node pairs are traversed together, differing bits are accumulated and a pair
is pruned once it exceeds the budget.  A partition returns a spanning forest of the
links it finds, never all pairs.  Components come from alternating large-star and
small-star rounds on DataFrames, each cut by a checkpoint.

Defined results: a null, empty or wordless text has fingerprint zero and links like any
other; fewer words than a shingle form one shingle; ties (exactly half) give bit 0;
repeated rows each keep a row; a component of rows without ids has a null id; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import FOLD, durable, fresh, require, small

SHINGLE, BUDGET, SEED = 3, 3, 42
#: Shingles hashed at once; bounds memory on very long texts.
CHUNK = 1 << 16
#: Node pairs expanded at once, and the size up to which two nodes are compared directly.
PAIRS, DIRECT = 1 << 18, 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends[shingle - 1 :].tolist() or [len(joined)]
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=False)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) for each row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th bigint, fp bigint")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        if (open_ := la != lb).sum() == 0:
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def trie_forest(codes: np.ndarray, first: int, budget: int) -> np.ndarray:
    """Component labels of sorted distinct 64-bit codes, linked if they share the first ``first`` bits and differ in at most ``budget``."""
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    cells = np.flatnonzero(np.concatenate(([True], (codes[1:] ^ codes[:-1]) >> np.uint64(64 - first) != 0))) if first else np.array([0])
    ends = np.append(cells[1:], n)
    many = ends - cells > 1
    lo, hi = cells[many], ends[many]
    stack = [(first, *x) for x in _cut(np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        depth, nodes = stack.pop()
        a0, a1, b0, b1, used = nodes
        if depth == 64:
            direct = np.ones(len(a0), bool)
        else:
            direct = (a1 - a0) * (b1 - b0) <= DIRECT
        if direct.any():
            s, t = _pairs(*nodes[:4, direct])
            near = np.bitwise_count(codes[s] ^ codes[t]) <= budget
            s, t = s[near], t[near]
            fresh = label[s] != label[t]
            if fresh.any():
                label = _merge(label, s[fresh], t[fresh])
        nodes = nodes[:, ~direct]
        if not nodes.shape[1]:
            continue
        a0, a1, b0, b1, used = nodes
        bit = np.uint64(1) << np.uint64(63 - depth)
        keep = ~(np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(0xFFFFFFFFFFFFFFFF))
        am = np.searchsorted(codes, (codes[a0] & keep) | bit)
        bm = np.searchsorted(codes, (codes[b0] & keep) | bit)
        twin = a0 == b0
        kids = np.concatenate(
            [
                np.stack([a0, am, b0, bm, used]),
                np.stack([am, a1, bm, b1, used]),
                np.stack([a0, am, bm, b1, used + 1]),
                np.stack([am, a1, b0, bm, used + 1])[:, ~twin],
            ],
            axis=1,
        )
        kids = kids[:, (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)]
        kids = kids[:, ~((kids[0] == kids[2]) & (kids[1] - kids[0] == 1))]
        stack += [(depth + 1, *x) for x in _cut(kids)]
    return label


def _cut(nodes: np.ndarray) -> list[tuple[np.ndarray]]:
    return [(nodes[:, i : i + PAIRS],) for i in range(0, nodes.shape[1], PAIRS)]


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs s < t of the node pairs."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    node = np.repeat(np.arange(len(a0)), count)
    k = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
    s, t = a0[node] + k // wide[node], b0[node] + k % wide[node]
    return s[s < t], t[s < t]


def _merge(label: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``label`` with the groups of s and t joined."""
    old = np.unique(np.concatenate((label[s], label[t])))
    new = old[_components(len(old), np.searchsorted(old, label[s]), np.searchsorted(old, label[t]))]
    moved = label.copy()
    moved[old] = new  # roots first
    return moved[moved[label]]


def links(codes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): a spanning forest, for each block, of the links between distinct fingerprints ``fp``."""
    blocks = budget + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    turned = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftleft(fp, {s}) | shiftrightunsigned(fp, {(64 - s) % 64})" if s else "fp").alias("code")) for k, s in enumerate(edges[:-1])])
    first = min(b - a for a, b in zip(edges, edges[1:], strict=False))
    dealt = codes.select(F.explode(turned).alias("x")).select("x.k", "x.code")
    dealt = dealt.withColumn("cell", F.expr(f"shiftrightunsigned(code, {64 - first})"))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "k", "cell").select("k", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if not got:
            return
        ks, cs = (np.concatenate(x) for x in zip(*got, strict=True))
        for k in range(blocks):
            c = np.unique(cs[ks == k])
            label = trie_forest(c, first, budget)
            linked = np.flatnonzero(label != np.arange(len(c)))
            s = np.uint64(edges[k])
            back = c if not s else (c >> s) | (c << (np.uint64(64) - s))
            for i in range(0, len(linked), 1 << 16):
                at = linked[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(back[at].view(np.int64)), pa.array(back[label[at]].view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")


#: A key is hot if it holds one row in HOT or more; at most HOT keys are, whatever the size of the table.
HOT = 1000


def join_hot(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``named``: one row a key, with the number ``n`` of its rows among all ``total``.

    The rows of hot keys meet them by broadcast where they lie, so no task gathers them; the others are shuffled.
    """
    hot = F.col("n") * HOT >= total
    many = named.filter(hot)
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(named.filter(~hot), key)
    return rows.join(F.broadcast(many), key).unionByName(rest).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v): root is the smallest node of its component.

    Alternating large-star and small-star rounds; a hub's neighbours are never gathered:
    their minimum is one aggregated row, which goes to the hub's edges where they lie.
    """
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    size, state = edges.count(), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        edges = join_hot(both, low, "u", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = durable(edges)
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        edges = durable(join_hot(edges, low, "u", edges.count()).select(pair.alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, size = now, now[0]


def near_groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, th, fp, root (the smallest linked fingerprint) and component_id (the smallest doc_id reachable) for each row."""
    rows = durable(with_fingerprint(docs, shingle))
    codes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    every, distinct = codes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    comp = components(links(codes, budget))
    rooted = codes.join(comp, codes["fp"] == comp["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = durable(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_code = durable(join_hot(rooted, named, "root", distinct).select("fp", "root", "component_id", F.col("copies").alias("n")))
    return join_hot(rows, by_code, "fp", every).select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id (then the smallest text hash); all columns stay.

    Rows without an id are kept only where no row of their group has one.
    """
    return keep_first(docs, near_groups(docs, shingle, budget))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first document of each of ``groups`` (doc_id, th, root, component_id)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    mine = F.coalesce(F.col("component_id").cast("string"), F.lit("\0")), F.when(F.col("component_id").isNull(), F.col("root"))
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(mine[0].alias("id"), mine[1].alias("f")).agg(F.min("th").alias("th"))
    first = durable(first.select("id", "th"))
    n = first.count()
    copies = durable(groups.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("id"), "th").count().filter("count > 1").select("id", "th"))
    again = copies.count()
    near_id, near_th = fresh(docs, "_near_id"), fresh(docs, "_near_th")
    keyed = docs.withColumns({near_id: F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), near_th: F.xxhash64("text")})

    def among(keys: DataFrame, how: str, rows: DataFrame, size: int) -> DataFrame:
        keys = small(keys.select(F.col("id").alias(near_id), F.col("th").alias(near_th)), size, 64)
        return rows.join(keys, [near_id, near_th], how)

    kept = among(first, "left_semi", keyed, n)
    if again:  # rows repeated whole: one of each
        single = among(copies, "left_anti", kept, again)
        kept = single.union(among(copies, "left_semi", kept, again).dropDuplicates([near_id, near_th]))
    return kept.select(*names)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

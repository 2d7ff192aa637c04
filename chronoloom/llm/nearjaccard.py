"""Near-duplicate groups of whole texts: five-word shingle sets with Jaccard similarity of at least 0.8.

Texts with one shingle set are one code.  First comes SimHash, as in ``simhash``: fingerprints,
the trie self-join and its links, each verified by the exact Jaccard similarity of the two texts;
codes with one fingerprint are linked to the least of them.  What it links needs no more than that.

Similar texts may differ in more bits than a trie can search, so what is still apart is completed:
every code has MinHash values in ``BANDS`` bands of ``ROWS``; codes that agree on a band are
candidates.  A pair of similarity s is no candidate with probability (1 - s^ROWS)^BANDS: 5 in
100 000 at 0.8, less above.

Within a bucket codes are compared by parity sketches: a bit for each residue of a shingle's
hash, set if an odd number of shingles have it.  Two sketches never differ in more bits than
their sets in shingles, and a similarity of at least 0.8 means that at most a ninth of both
sizes differ; so what the sketches exclude is dissimilar for certain, and nearly all dissimilar
pairs are excluded.  A bucket returns a spanning forest of what is left and not yet linked, surest
pairs first, and each of its edges is verified by the exact Jaccard similarity of the two texts.  Whatever
is then still in different components, but not excluded, is verified pair by pair.  So neither
the pairs of a group of near copies nor those of unlike texts in one bucket are ever rows.
Buckets with the same codes are one; a large bucket is dealt into blocks of bounded size, which
meet two by two.  Components are those of ``simhash``; up to ``LOCAL`` edges are contracted in one task.

Every stage costs a task for each partition, however few rows there are, so a table that was cut by a
checkpoint is read in as many parts as its counted rows need, and small sides of joins are broadcast.

Defined results: texts without a word are copies of each other; fewer words than a shingle
form one shingle; a group is linked through any chain of similar texts; nulls, repeated rows
and rows without an id are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_BYTES, FOLD, durable, require, small
from chronoloom.llm.simhash import _components, components, fingerprint, join_hot, keep_first, links

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 25, 5
#: Codes of a block of a large bucket; bits of a sketch for each shingle, and at least.
BLOCK, SKETCH, LEAST_BITS = 4096, 4, 256
#: Share of the bound up to which an estimated difference counts as sure.
SURE = 0.95
#: Shingles hashed at once; bounds memory on very long texts.
CHUNK = 1 << 12
#: Rows of a task that reads a checkpoint: narrow ones, codes with sketches, texts.
NARROW, WIDE, TEXTS = 1 << 14, 1 << 12, 1 << 9
#: Edges up to which components are found in one task, of 16 bytes an edge.
LOCAL = 1 << 20
#: Bytes that a row of some numbers takes in a broadcast table.
ROW_BYTES = 48

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band; none for a text without a word."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (_FACTORS * hashes[at : at + CHUNK]).min(1))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(low.reshape(BANDS, ROWS))]


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of shingles with each residue; halves of it xor to the sketch of half the size."""
    bits = max(LEAST_BITS, 1 << (SKETCH * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def with_code(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), code (of the shingle set), its size and sketch, keys (of the bands) and fp (the fingerprint) for each row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, sizes, sketches, keys, prints = [], [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py())
                prints.append(fingerprint(t.as_py()))
                codes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                sketches.append(sketch(h))
                keys.append(np.array(band_keys(h), np.uint64).view(np.int64))
            code = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), code, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "th", "code", "size", "sketch", "keys", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")).mapInArrow(
        run, f"doc_id {kind}, th bigint, code bigint, size bigint, sketch binary, keys array<bigint>, fp bigint"
    )


def _buckets(codes: DataFrame) -> DataFrame:
    """(key, i, j, block, code): the members of each distinct bucket, with a row for each cell (i, j) of blocks that they meet in."""
    dealt = codes.select("code", F.explode("keys").alias("key"))
    # Buckets of the same codes, told by two sums without order, are one.
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("code").alias("x"), F.bit_xor(F.xxhash64("code")).alias("y")).filter("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = dealt.join(sizes, "key").withColumn("block", F.expr("cast(pmod(xxhash64(code, key), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "code")


class Bucket:
    """Codes by size, with their sketches, so that what one can be similar to follows it closely."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]):
        self.size = sizes
        bits = np.array(list(map(len, sketches)))
        self.last = np.searchsorted(sizes, sizes * SIMILAR[1] // SIMILAR[0], "right")
        self.parts = []  # of one length each: from, to, the sketches, and those folded to half the length
        cuts = [0, *(np.flatnonzero(np.diff(bits)) + 1).tolist(), len(bits)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = np.frombuffer(b"".join(sketches[lo:hi]), np.uint64).reshape(hi - lo, -1)
            half = own.shape[1] // 2
            self.parts.append((lo, hi, own, own[:, :half] ^ own[:, half:]))
        self.part = np.searchsorted([p[1] for p in self.parts], np.arange(len(bits)), "right")

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes after i that its sketch does not exclude, and whether they are similar by estimate."""
        lo, hi, own, _ = self.parts[self.part[i]]
        end = int(self.last[i])
        mine = own[i - lo]
        apart = np.bitwise_count(own[i + 1 - lo : min(hi, end) - lo] ^ mine).sum(1, dtype=np.int64)
        if end > hi:  # at most the next length
            lo2, _, _, folded = self.parts[self.part[i] + 1]
            apart = np.concatenate((apart, np.bitwise_count(folded[: end - lo2] ^ mine).sum(1, dtype=np.int64)))
        both = self.size[i] + self.size[i + 1 : i + 1 + len(apart)]
        # Similar: the difference d is at most both * (1 - s) / (1 + s).
        most = both * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])
        got = np.flatnonzero(apart <= most)
        bits = 64 * own.shape[1]
        guess = -bits / 2 * np.log(np.maximum(1e-9, 1 - 2 * apart[got] / bits))
        return got + i + 1, guess <= SURE * most[got]


def _forest(bucket: Bucket, block: np.ndarray, root: np.ndarray, across: bool) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs that are not excluded, sure ones first; only of different blocks if ``across``, and of different roots."""
    n = len(block)
    label = np.unique(root, return_inverse=True)[1]
    s: list[int] = []
    t: list[int] = []
    for sure in (True, False):
        for i in range(n - 1):
            if bucket.last[i] <= i + 1:
                continue
            at, good = bucket.near(i)
            at = at[good] if sure else at
            if across:
                at = at[block[at] != block[i]]
            at = at[label[at] != label[i]]
            if len(at):
                old, first = np.unique(label[at], return_index=True)
                s += [i] * len(old)
                t += at[first].tolist()
                label[np.isin(label, old)] = label[i]
        if (label == label[0]).all():
            break
    return s, t


def _pairs(buckets: DataFrame, codes: DataFrame, first: bool) -> DataFrame:
    """Distinct pairs u < v to verify: at ``first`` a spanning forest of each cell, then all that are not excluded and of different roots (of ``codes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for across, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = cell.values
                code, block, size, root = (x.field(k).to_numpy() for k in ("code", "block", "size", "root"))
                order = np.lexsort((code, size))
                code, block, size, root = code[order], block[order], size[order], root[order]
                held = x.field("sketch")
                bucket = Bucket(size, [held[k].as_py() for k in order.tolist()])
                if first:
                    s, t = _forest(bucket, block, root, across)
                else:
                    s, t = [], []
                    for i in range(len(code) - 1):
                        at = bucket.near(i)[0]
                        at = at[(root[at] != root[i]) & ((block[at] != block[i]) | (not across))]
                        s += [i] * len(at)
                        t += at.tolist()
                us.append(np.minimum(code[s], code[t]))
                vs.append(np.maximum(code[s], code[t]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    cells = buckets.join(codes.select("code", "size", "sketch", "root"), "code").groupBy("key", "i", "j").agg(F.collect_list(F.struct("code", "block", "size", "root", "sketch")).alias("x"))
    return cells.select((F.col("i") < F.col("j")).alias("across"), "x").mapInArrow(run, "u bigint, v bigint").distinct()


def _parts(df: DataFrame, rows: int, each: int) -> DataFrame:
    """A checkpointed table of ``rows`` rows in parts of about ``each``."""
    return df.coalesce(max(1, -(-rows // each)))


def _packed(df: DataFrame) -> tuple[DataFrame, int]:
    """A table of narrow rows, cut by a checkpoint, and its number of rows."""
    df = durable(df)
    n = df.count()
    return _parts(df, n, NARROW), n


def _printed(codes: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Distinct pairs u < v to verify by SimHash, and their number: the least codes of linked fingerprints, and each code with the least of its fingerprint."""
    prints, _ = _packed(codes.groupBy("fp").agg(F.min("code").alias("least"), F.count("*").alias("n")))
    far, n = _packed(links(prints.select("fp")))
    u, v = prints.select(F.col("fp").alias("u"), F.col("least").alias("a")), prints.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    far = small(small(far, n, ROW_BYTES).join(u, "u"), n, ROW_BYTES).join(v, "v").select("a", "b")
    many, own = prints.filter("n > 1"), codes.select("fp", "code")
    shared = many.count()
    near = own.join(F.broadcast(many), "fp") if shared * ROW_BYTES <= BROADCAST_BYTES else join_hot(own, many, "fp", total)
    near = near.select(F.col("code").alias("a"), F.col("least").alias("b"))
    return _packed(far.union(near).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def _roots(edges: DataFrame, n: int) -> DataFrame:
    """``components`` of n edges."""
    if n > LOCAL:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        u, v = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes = np.unique(np.concatenate((u, v)))
        root = nodes[_components(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))]
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, root bigint")


def _rooted(codes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    comp = small(_roots(edges, n), 2 * n, ROW_BYTES)
    return durable(codes.join(comp, codes["code"] == comp["node"], "left").select("code", "least", "th", "size", "sketch", F.coalesce("root", "code").alias("root")))


def _verified(docs: DataFrame, codes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Those of n pairs whose texts are similar."""
    if not n:
        return pairs
    ends = pairs.select(F.explode(F.array("u", "v")).alias("code"))
    ends = F.broadcast(ends) if 2 * n * ROW_BYTES <= BROADCAST_BYTES else ends.distinct()
    named, k = _packed(codes.select("code", "th").join(ends, "code", "left_semi"))
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")).join(small(named, k, 32), "th")
    texts = _parts(durable(texts.groupBy("code").agg(F.first("text").alias("text"))), k, TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            good = []
            for u, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if u != last:
                    last, own = u, shingles(s.as_py())
                good.append(similar(own, shingles(t.as_py())))
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    a, b = texts.toDF("u", "s"), texts.toDF("v", "t")
    return pairs.join(b, "v").join(a, "u").select("u", "v", "s", "t").mapInArrow(run, "u bigint, v bigint")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, code, root (the smallest linked code) and component_id (the smallest doc_id reachable) for each row."""
    rows = durable(with_code(docs))
    codes = rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min("fp").alias("fp"), F.count("*").alias("copies"))
    codes = durable(codes)
    n, every = codes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    rows, codes = _parts(rows, every, WIDE), _parts(codes, n, WIDE)
    printed, n_printed = _printed(codes, n)
    edges, n_edges = _packed(_verified(docs, codes, printed, n_printed))
    buckets, _ = _packed(_buckets(codes))
    pairs, n_pairs = _packed(_pairs(buckets, _rooted(codes, edges, n_edges), True).join(small(printed, n_printed, ROW_BYTES), ["u", "v"], "left_anti"))
    edges, n_edges = _packed(edges.union(_verified(docs, codes, pairs, n_pairs)))
    rooted = _rooted(codes, edges, n_edges)
    # Only buckets whose codes are not one component have anything left.
    mixed = buckets.join(small(rooted.select("code", "root"), n, ROW_BYTES), "code").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    mixed, n_mixed = _packed(mixed)
    if n_mixed:
        done = small(pairs.union(printed), n_pairs + n_printed, ROW_BYTES)
        more, n_more = _packed(_pairs(buckets.join(small(mixed, n_mixed, ROW_BYTES), "key", "left_semi"), rooted, False).join(done, ["u", "v"], "left_anti"))
        if n_more:
            rooted = _rooted(codes, *_packed(edges.union(_verified(docs, codes, more, n_more))))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = durable(rooted.join(small(named, n, ROW_BYTES), "root").select(F.col("code").alias("_code"), "root", "component_id"))
    return rows.select("doc_id", "th", "code").join(small(by_code, n, ROW_BYTES), rows["code"] == by_code["_code"]).drop("_code")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, chosen as in ``simhash``; all columns stay."""
    return keep_first(docs, near_groups(docs))

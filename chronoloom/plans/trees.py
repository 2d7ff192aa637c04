"""Histogram trees on Spark: gradient boosting grown by leaves, extremely randomised forests, boosted stumps.

Columns become bin numbers (quantiles; code 0 is a missing value, which goes to whichever side
gains more), and rows become blocks of ``BLOCK``, column by column in binary cells.  A pass
over the blocks sums gradients by node, feature and bin in each task; the sums merge by groups
of ``FAN_IN`` tasks until so few are left, so the driver receives a table whose size depends on
nodes, features and bins alone.  Trees grow best leaf first, exactly, yet with one pass for each
level: nodes are evaluated ahead of their being chosen, level by level, and the choice among
them is made on the driver.  Leaves may hold a vector, one tree for all targets.  Margins are
kept in the blocks and brought up to date every ``CUT`` trees behind a checkpoint.

Rows without a target (null or not a number) are left out.  Samples of rows are drawn by a hash of the row's own
values, so a recomputed task draws the same.  Equal gains go to the lower feature and bin, equal
leaves to the one nearer the root and then to the left.

The L1 objective, of which fits are long, reads its rows once a round instead of once a level: rows with equal codes are dealt side by side
and share one margin (a cell), their signs are summed by cell, and the passes of a tree go over the cells. Blocks and cells are kept by the
executors; what is lost is made again from the checkpointed rows and the trees so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import durable, small_batches

Cols = Sequence[str]

BLOCK, FAN_IN, CUT = 16_384, 16, 25
#: The median of a leaf is sought by counts in so many bins, until at most so many values are left in all leaves' bins together, or after so many steps.
MEDIAN_BINS, MEDIAN_LEFT, MEDIAN_STEPS = 512, 20_000, 4
#: A pass over cells counts pairs of features if all pairs have so many bins at most.
PAIRS = 32_768


# Bins and blocks -------------------------------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """The bins' inclusive upper ends for each feature; the last bin has none."""

    features: list[str]
    edges: list[np.ndarray]

    @property
    def width(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """rows x features; 0 where a value is missing."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (v, e) in enumerate(zip(columns, self.edges, strict=True)):
            out[:, k] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1)
        return out


def quantile_bins(df: DataFrame, features: Cols, bins: int = 31) -> Bins:
    """At most ``bins`` bins a feature at its quantiles, all from one aggregation of sketches."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be between 2 and 255")
    at = [k / bins for k in range(1, bins)] + [1.0]
    got = df.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), at, 10_000).alias(str(k)) for k, c in enumerate(features)]).first()
    edges = [np.unique(np.array(q, float)) if q else np.zeros(0) for q in got]
    return Bins(list(features), [e[:-1] for e in edges])


@dataclass(frozen=True)
class Blocks:
    """(valid, n, k, x, y, m): rows of one kind, hashes, codes by feature, targets and margins by row."""

    df: DataFrame
    bins: Bins
    targets: int

    @property
    def tasks(self) -> int:
        return self.df.rdd.getNumPartitions()


_BLOCK = "valid boolean, n int, k binary, x binary, y binary, m binary"


def _block(valid: bool, k: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    held = [np.ascontiguousarray(a).tobytes() for a in (k, x.T, y, m)]
    return pa.RecordBatch.from_arrays([pa.array([valid]), pa.array([len(k)], pa.int32()), *(pa.array([b], pa.binary()) for b in held)], ["valid", "n", "k", "x", "y", "m"])


def _opened(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[tuple]:
    """(valid, hashes, codes, targets, margins) of each block; views of the batch, of which nothing is copied."""
    for b in batches:
        for i in range(b.num_rows):
            valid, n, *held = (c[i] for c in b.columns)
            n = n.as_py()
            k, x, y, m = (np.frombuffer(h.as_buffer(), t) for h, t in zip(held, (np.int64, np.uint8, np.float64, np.float64), strict=True))
            yield valid.as_py(), k, x.reshape(-1, n).T, y.reshape(n, targets), m.reshape(n, targets)


def blocks(df: DataFrame, bins: Bins, targets: Cols, valid: Column | None = None) -> Blocks:
    """The binned rows of ``df`` that have all targets, with margins of zero; rows where ``valid`` holds only measure the loss."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    xs, ys = [number(c).alias(f"x{i}") for i, c in enumerate(bins.features)], [number(c).alias(f"y{i}") for i, c in enumerate(targets)]
    rows = df.select(F.coalesce(valid, F.lit(False)).alias("v") if valid is not None else F.lit(False).alias("v"), *xs, *ys)
    rows = rows.withColumn("h", F.xxhash64(*[c for c in rows.columns if c != "v"]))
    many, p = len(targets), len(bins.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}

        def put(v: bool) -> pa.RecordBatch:
            k, x, y = (np.concatenate(a) for a in zip(*held[v], strict=True))
            held[v] = []
            return _block(v, k, x, y, np.zeros(y.shape))

        for b in batches:
            cols = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[1 : 1 + p + many]]
            flag, k = b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1 + p + many).to_numpy()
            x, y = bins.codes(cols[:p]) if p else np.zeros((b.num_rows, 0), np.uint8), np.column_stack(cols[p:])
            for v in (False, True):
                at = np.flatnonzero((flag == v) & ~np.isnan(y).any(1))
                for i in range(0, len(at), BLOCK):
                    j = at[i : i + BLOCK]
                    held[v].append((k[j], x[j], y[j]))
                    if sum(len(a[0]) for a in held[v]) >= BLOCK:
                        yield put(v)
        yield from (put(v) for v in (False, True) if held[v])

    return Blocks(durable(rows.mapInArrow(run, _BLOCK)), bins, many)


def _summed(df: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of the vectors ``s`` (binary) of all tasks, by groups of FAN_IN until that many are left."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"part": [key[0].as_py()], "s": [sum(np.frombuffer(s.as_py()) for s in table.column("s")).tobytes()]}, pa.schema([("part", pa.int64()), ("s", pa.binary())]))

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        df = df.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(merge, "part bigint, s binary")
    got = [np.frombuffer(r["s"]) for r in sorted(df.collect(), key=lambda r: r["part"])]  # at most FAN_IN rows
    return np.sum(got, axis=0) if got else None


def _pass(data: Blocks, task) -> np.ndarray | None:
    """``task`` adds what it makes of each opened block into one vector a partition; the sum of them."""
    targets = data.targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for block in _opened(batches, targets):
            own = task(*block)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "s"])

    return _summed(data.df.mapInArrow(run, "part bigint, s binary"), data.tasks)


# Trees -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes by number, the root first; feature -1 is a leaf. Codes up to ``cut`` go left, missing ones where ``missing`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[list[float]] = field(default_factory=list)

    def split(self, node: int, feature: int, cut: int, missing: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing[node], self.gain[node] = feature, cut, missing, gain
        for _ in range(2):
            for a, v in ((self.feature, -1), (self.cut, 0), (self.missing, False), (self.left, -1), (self.right, -1), (self.gain, 0.0)):
                a.append(v)
        self.left[node], self.right[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, missing, left, right = (np.array(a) for a in (self.feature, self.cut, self.missing, self.left, self.right))
        at = np.zeros(len(codes), np.int64)
        open_ = np.arange(len(codes)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            c = codes[open_, feature[node]]
            at[open_] = np.where(np.where(c == 0, missing[node], c <= cut[node]), left[node], right[node])
            open_ = open_[feature[at[open_]] >= 0]
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value, float)[self.nodes(codes)]

    def below(self) -> list[list[int]]:
        """The leaves under each node."""
        out: list[list[int]] = [[] for _ in self.feature]
        for n in reversed(range(len(self.feature))):  # children have larger numbers
            out[n] = out[self.left[n]] + out[self.right[n]] if self.feature[n] >= 0 else [n]
        return out


class Lookup:
    """What a tree says of rows, column by column: each feature's code leaves a set of leaves open, as bits, and one is left in all of them.

    ``given`` holds a value for each node; trees of more than 64 leaves are walked.
    """

    SPREAD = np.uint64(0x03F79D71B4CB0A89)  # times a power of two, the upper six bits tell which

    def __init__(self, tree: Tree, given: np.ndarray, width: int):
        below = tree.below()
        self.tree, self.given, self.tables = None, given, []
        if len(below[0]) > 64:
            self.tree = tree
            return
        bit = {leaf: 1 << i for i, leaf in enumerate(below[0])}
        place = (np.array(list(bit.values()), np.uint64) * self.SPREAD) >> np.uint64(58)
        self.given = np.zeros((64, *given.shape[1:]), given.dtype)
        self.given[place] = given[below[0]]
        self.first = given[below[0][0]]
        every = (1 << len(bit)) - 1
        tables: dict[int, np.ndarray] = {}
        for n, f in enumerate(tree.feature):
            if f >= 0:
                t = tables.setdefault(f, np.full(width, every, np.uint64))
                codes = np.arange(width)
                left = np.where(codes == 0, tree.missing[n], codes <= tree.cut[n])
                shut = [np.uint64(every ^ sum(bit[leaf] for leaf in below[side])) for side in (tree.right[n], tree.left[n])]
                t &= np.where(left, shut[0], shut[1])
        self.tables = sorted(tables.items())

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The value of each row's leaf; ``codes``: features x rows."""
        if self.tree is not None:
            return self.given[self.tree.nodes(codes.T)]
        if not self.tables:
            return np.repeat(self.first[None], codes.shape[1], axis=0)
        open_ = None
        for f, t in self.tables:
            own = t.take(codes[f])
            open_ = own if open_ is None else np.bitwise_and(open_, own, out=open_)
        open_ *= self.SPREAD
        open_ >>= np.uint64(58)
        return self.given.take(open_.view(np.int64), axis=0)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing: bool
    left: np.ndarray  # gradients, curvature and rows of both sides
    right: np.ndarray


@dataclass(frozen=True)
class Penalty:
    l1: float = 0.0
    l2: float = 0.0
    rows: int = 20
    curvature: float = 1e-3
    gain: float = 0.0

    def shrunk(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0)

    def score(self, s: np.ndarray) -> np.ndarray:
        """Twice the fall of the objective; ``s``: gradients by target, curvature, rows."""
        h = s[..., -2] + self.l2
        return (self.shrunk(s[..., :-2]) ** 2).sum(-1) / np.where(h > 0, h, np.inf)

    def value(self, s: np.ndarray) -> np.ndarray:
        h = s[-2] + self.l2
        return -self.shrunk(s[:-2]) / h if h > 0 else np.zeros(len(s) - 2)


def best_split(hist: np.ndarray, penalty: Penalty, features: Sequence[int], draw: np.random.Generator | None = None) -> Split | None:
    """The best cut of a node by its sums (feature, bin, sums); with ``draw`` one random cut for each feature."""
    total = hist[0].sum(0)
    base, best = penalty.score(total), None
    for f, h in zip(features, hist, strict=True):
        below = np.cumsum(h[1:], axis=0)[:-1]  # after each bin but the last
        if draw is not None:
            held = np.flatnonzero(h[1:, -1] > 0)
            cuts = np.array([draw.integers(held[0], held[-1])]) if len(held) > 1 else np.zeros(0, int)
        else:
            cuts = np.arange(len(below))
        if not len(cuts):
            continue
        for missing in (False, True) if h[0, -1] > 0 else (False,):
            left = below[cuts] + (h[0] if missing else 0)
            right = total - left
            gain = penalty.score(left) + penalty.score(right) - base
            fine = (np.minimum(left[:, -1], right[:, -1]) >= penalty.rows) & (np.minimum(left[:, -2], right[:, -2]) >= penalty.curvature)
            gain = np.where(fine, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > penalty.gain and gain[k] > 1e-12 * abs(base) and (best is None or gain[k] > best.gain):
                best = Split(float(gain[k]), f, int(cuts[k]) + 1, missing, left[k], right[k])
    return best


class Grower:
    """One tree, best leaf first; nodes are named by the turns that lead to them."""

    def __init__(self, leaves: int, depth: int):
        self.leaves, self.depth = leaves, depth
        self.known: dict[str, Split | None] = {}
        self.total: np.ndarray | None = None

    def _chosen(self) -> tuple[list[str], list[str], list[str]]:
        """(splits in order, leaves then, leaves whose sums are needed before going on)."""
        splits, leaves = [], [""]
        while len(leaves) < self.leaves:
            if unknown := [p for p in leaves if p not in self.known]:
                return splits, leaves, unknown
            able = [p for p in leaves if self.known[p] is not None]
            if not able:
                break
            p = min(able, key=lambda p: (-self.known[p].gain, len(p), p))
            splits.append(p)
            leaves.remove(p)
            leaves += [p + "0", p + "1"]
        return splits, leaves, []

    def wanted(self) -> list[str]:
        """The nodes to evaluate in the next pass, none if the tree is whole: those that block, and what else would be a leaf if they weren't split."""
        _, leaves, unknown = self._chosen()
        if not unknown:
            return []
        while len(leaves) < self.leaves and (able := [p for p in leaves if self.known.get(p) is not None]):
            p = min(able, key=lambda p: (-self.known[p].gain, len(p), p))
            leaves.remove(p)
            leaves += [p + "0", p + "1"]
        return sorted(p for p in leaves if p not in self.known)

    def put(self, name: str, hist: np.ndarray, penalty: Penalty, features: Sequence[int], draw: np.random.Generator | None = None) -> None:
        if not name:
            self.total = hist[0].sum(0)
        self.known[name] = best_split(hist, penalty, features, draw) if len(name) < self.depth else None
        for s in "01":
            if len(name) + 1 >= self.depth:
                self.known[name + s] = None

    def ahead(self, names: Sequence[str]) -> tuple[Tree, dict[str, int]]:
        """The tree down to ``names``, and their nodes."""
        need = {n[:k] for n in names for k in range(len(n))}
        return self._tree(sorted(need, key=lambda p: (len(p), p)))

    def _tree(self, splits: Sequence[str]) -> tuple[Tree, dict[str, int]]:
        tree, at = Tree(), {"": 0}
        for p in splits:
            s = self.known[p]
            at[p + "0"], at[p + "1"] = tree.split(at[p], s.feature, s.cut, s.missing, s.gain)
        return tree, at

    def sums(self, name: str) -> np.ndarray:
        return self.total if not name else getattr(self.known[name[:-1]], "left" if name[-1] == "0" else "right")

    def grown(self, penalty: Penalty, rate: float) -> Tree:
        splits, leaves, _ = self._chosen()
        tree, at = self._tree(splits)
        width = len(self.total) - 2
        tree.value = [[0.0] * width for _ in tree.feature]
        for p in leaves:
            tree.value[at[p]] = (rate * penalty.value(self.sums(p))).tolist()
        return tree


def _histogram(codes: np.ndarray, slot: np.ndarray, sums: np.ndarray, slots: int, features: Sequence[int], width: int) -> np.ndarray:
    """slot x feature x bin x sums, over the rows whose slot isn't negative."""
    on = slot >= 0
    codes, slot, sums = codes[on], slot[on], sums[on]
    out = np.zeros((slots, len(features), width, sums.shape[1]))
    for k, f in enumerate(features):
        cell = slot * width + codes[:, f]
        for j in range(sums.shape[1]):
            out[:, k, :, j] = np.bincount(cell, sums[:, j], slots * width).reshape(slots, width)
    return out


def _slots(tree: Tree, at: dict[str, int], names: Sequence[str]) -> np.ndarray:
    """The place among ``names`` of each node, -1 for others."""
    slot = np.full(len(tree.feature), -1)
    for k, n in enumerate(names):
        slot[at[n]] = k
    return slot


# Cells of the L1 objective -----------------------------------------------------------------


def cell_blocks(df: DataFrame, bins: Bins, target: str, valid: Column | None, about: int) -> RDD:
    """(valid, codes by feature and cell, rows before each cell, targets and hashes by row) of blocks whose rows are ordered by their codes.

    Rows are dealt by ranges of their codes and of a hash of all they hold, so that many rows of one code are shared by tasks; ``about``
    so many rows, of which few need few tasks.
    """
    number = lambda c: F.col(f"`{c}`").cast("double")
    p, spark = len(bins.features), df.sparkSession
    xs, y = [number(c).alias(f"x{i}") for i, c in enumerate(bins.features)], number(target).alias("y0")
    own = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])
    rows = df.select(F.coalesce(valid, F.lit(False)).alias("v") if valid is not None else F.lit(False).alias("v"), *xs, y, own.alias("own"))
    rows = rows.withColumn("h", F.xxhash64(*[f"x{i}" for i in range(p)], "y0")).filter("y0 is not null and not isnan(y0)")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[1 : 1 + p]]
            x = bins.codes(cols) if p else np.zeros((b.num_rows, 0), np.uint8)
            held = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(0, (b.num_rows + 1) * p, p, np.int32) if p else np.zeros(b.num_rows + 1, np.int32)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), held, *b.columns[1 + p :]], ["v", "c", "y0", "own", "h"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}

        def put(v: bool) -> pa.RecordBatch:
            x, y, h = (np.concatenate(a) for a in zip(*held[v], strict=True))
            held[v] = []
            new = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
            first = np.flatnonzero(new)
            parts = [np.ascontiguousarray(x[first].T), first.astype(np.int32), y, h]
            return pa.RecordBatch.from_arrays([pa.array([v]), *(pa.array([a.tobytes()], pa.binary()) for a in parts)], ["v", "x", "first", "y", "h"])

        for b in batches:
            flag, y, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, p)
            for v in (False, True):
                at = np.flatnonzero(flag == v)
                for i in range(0, len(at), BLOCK):
                    j = at[i : i + BLOCK]
                    held[v].append((x[j], y[j], h[j]))
                    if sum(len(a[0]) for a in held[v]) >= BLOCK:
                        yield put(v)
        yield from (put(v) for v in (False, True) if held[v])

    def opened(r) -> tuple:
        first = np.frombuffer(r.first, np.int32)
        return r.v, np.frombuffer(r.x, np.uint8).reshape(p, len(first)), first, np.frombuffer(r.y), np.frombuffer(r.h, np.int64)

    tasks = min(spark.sparkContext.defaultParallelism, about // (8 * BLOCK) + 1)  # a task costs more than a few blocks
    parts = min(4 * tasks, about // BLOCK + 1)
    coded = rows.mapInArrow(code, "v boolean, c binary, y0 double, own bigint, h bigint")
    dealt = coded.repartitionByRange(parts, "v", "c", "own").sortWithinPartitions("v", "c").select("v", "c", "y0", "h")
    return durable(dealt.mapInArrow(pack, "v boolean, x binary, first binary, y binary, h binary")).rdd.coalesce(min(tasks, parts)).map(opened)


def _moved_cells(block: tuple, start: float, trees: list[Lookup]) -> tuple:
    """The block with the margin of each cell."""
    m = np.full(block[1].shape[1], start)
    for t in trees:
        m += t(block[1])
    return (*block, m)


def _rest(x: np.ndarray, first: np.ndarray, y: np.ndarray, m: np.ndarray, pending: list[Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """The residual of each row, and the rows of each cell."""
    many = np.diff(first, append=len(y))
    for t in pending:
        m = m + t(x)
    with np.errstate(invalid="ignore"):
        rest = y - np.repeat(m, many)
        return (np.where(np.isnan(rest), 0.0, rest) if np.isnan(rest.sum()) else rest), many  # an infinite target that is met


def _signs(blocks: Iterator[tuple], pending: list[Lookup], sampled) -> Iterator[tuple]:
    """(loss and rows of both kinds, ends of the residuals, codes by cell, sums of the sampled gradients' signs, sampled rows) of blocks, many cells together."""
    head, low, high, held, many = np.zeros(4), np.inf, -np.inf, [], 0

    def put() -> tuple:
        x, g, n = (np.concatenate(a, axis=-1) for a in zip(*held, strict=True)) if held else (None, None, None)
        return head, low, high, x, g, n

    for valid, x, first, y, h, m in blocks:
        rest, _ = _rest(x, first, y, m, pending)
        loss = np.abs(rest).sum()
        if valid:
            head = head + [0, 0, loss, len(rest)]
            continue
        head = head + [loss, len(rest), 0, 0]
        fine = rest if np.isfinite(loss) else rest[np.isfinite(rest)]
        low, high = min(low, fine.min(initial=np.inf)), max(high, fine.max(initial=-np.inf))
        on = sampled(h)
        held.append((x, *(np.add.reduceat(a, first).astype(np.int32) for a in (np.where(on, -np.sign(rest), 0), on.astype(np.int32)))))
        many += len(first)
        if many >= 4 * BLOCK:
            yield put()
            head, low, high, held, many = np.zeros(4), np.inf, -np.inf, [], 0
    if head.any():
        yield put()


def _axes(features: Sequence[int], width: int) -> list[tuple[int, ...]]:
    """What a pass over cells counts by: pairs of features, which tell a node's children too; single features where pairs would be many."""
    pairs = [(f, g) for i, f in enumerate(features) for g in features[i + 1 :]]
    return pairs if pairs and len(pairs) * width**2 <= PAIRS else [(f,) for f in features]


def _cell_sums(made: tuple, slot: Lookup, slots: int, axes: Sequence[tuple[int, ...]], width: int) -> tuple:
    """(losses, slot x 2 x axes x bins of all features of an axis, ends) of a block of signs."""
    head, low, high, x, g, n = made
    size = width ** len(axes[0]) if axes else 0
    out = np.zeros((slots, 2, len(axes), size), np.int64)
    if x is not None:
        to = slot(x)
        on = np.flatnonzero((to >= 0) & (n > 0))
        if len(on) < len(to):
            x, to, g, n = x.take(on, axis=1), to[on], g[on], n[on]
        for k, axis in enumerate(axes):
            cell = to
            for f in axis:
                cell = cell * width + x[f]
            for j, v in enumerate((g, n)):
                out[:, j, k] = np.bincount(cell, v, slots * size).reshape(slots, size)
    return head, out, low, high


def _marginals(sums: np.ndarray, axes: Sequence[tuple[int, ...]], features: Sequence[int], width: int, split: Split | None = None, right: bool = False) -> np.ndarray:
    """feature x bin x (gradient, rows, rows) of a node by its sums over ``axes``, or of one side of its ``split``."""
    out = np.zeros((len(features), width, 3))
    side = np.ones(width, bool)
    if split is not None:
        side = np.where(np.arange(width) == 0, split.missing, np.arange(width) <= split.cut) != right
    for k, f in enumerate(features):
        if len(axes[0]) == 1:
            got = sums[:, k]
        else:
            other = split.feature if split is not None and split.feature != f else next(g for g in features if g != f)
            pair = sums[:, axes.index((min(f, other), max(f, other)))].reshape(2, width, width)
            pair = pair if f < other else pair.swapaxes(1, 2)  # its own bins first
            if split is None:
                got = pair.sum(2)
            elif split.feature == f:
                got = pair.sum(2) * side
            else:
                got = pair[:, :, side].sum(2)
        out[k] = got[[0, 1, 1]].T
    return out


def _both(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], np.add(a[1], b[1], dtype=np.int64), min(a[2], b[2]), max(a[3], b[3])


def _short(total: tuple) -> tuple:
    """The sums in the shortest integers that hold them."""
    top = np.abs(total[1]).max(initial=0)
    return total[0], total[1].astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)), *total[2:]


def _added(parts: RDD, both=_both, small=lambda total: total):
    """The sum of all tasks' sums, in groups first if there are many tasks; None without any."""

    def own(blocks: Iterator) -> Iterator:
        total = reduce(lambda a, b: b if a is None else both(a, b), blocks, None)
        return iter(() if total is None else (small(total),))

    sums = parts.mapPartitions(own)
    if sums.getNumPartitions() > FAN_IN:
        return sums.treeAggregate(None, *[lambda a, b: b if a is None else a if b is None else both(a, b)] * 2)
    return reduce(lambda a, b: b if a is None else both(a, b), sums.collect(), None)  # at most FAN_IN


def _in_bins(rest: np.ndarray, leaf: np.ndarray, steps: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that lie in the chosen bins of all steps but the last, whose bin is given (-1 without a last one)."""
    at, bin_ = np.arange(len(rest)), np.full(len(rest), -1)
    for low, scale, chosen in steps:
        own = leaf[at]
        bin_ = np.clip((rest[at] - low[own]) * scale[own], 0, MEDIAN_BINS - 1).astype(np.int64)
        if chosen is not None:
            keep = np.flatnonzero(bin_ == chosen[own])
            at, bin_ = at[keep], bin_[keep]
    return at, bin_


def _median_part(block: tuple, pending: list[Lookup], leaf: Lookup, leaves: int, sampled, steps: list[tuple]):
    """Sampled rows by leaf and bin of the last step; if all bins are chosen, (leaf, residual, rows) of what is left, as columns."""
    valid, x, first, y, h, m = block
    counting = steps[-1][2] is None
    if valid:
        return np.zeros(leaves * MEDIAN_BINS, np.int64) if counting else np.zeros((3, 0))
    rest, many = _rest(x, first, y, m, pending)
    on = np.flatnonzero(sampled(h))
    rest, own = rest[on], np.repeat(leaf(x), many)[on]
    at, bin_ = _in_bins(rest, own, steps)
    if counting:
        return np.bincount(own[at] * MEDIAN_BINS + bin_, minlength=leaves * MEDIAN_BINS)
    pairs, n = np.unique(np.stack((own[at], rest[at])), axis=1, return_counts=True)
    return np.concatenate((pairs, n[None]))


def _medians(moved: RDD, pending: list[Lookup], tree: Tree, leaves: list[int], width: int, sampled, ends: tuple) -> list[float | None]:
    """The lower median of each leaf's sampled residuals, exactly: counts in bins, finer ones in the bin that holds it, then the values left."""
    place = np.zeros(len(tree.feature), np.int64)
    place[leaves] = np.arange(len(leaves))
    part = partial(_median_part, pending=pending, leaf=Lookup(tree, place, width), leaves=len(leaves), sampled=sampled)
    low, size = np.full(len(leaves), ends[0] if np.isfinite(ends[0]) else 0.0), np.full(len(leaves), max(ends[1] - ends[0], 0.0) if np.isfinite(ends[0]) else 0.0)
    steps: list[tuple] = []
    rank, some = None, None
    while True:
        scale = np.divide(MEDIAN_BINS, size, out=np.full_like(size, 1e-300), where=size > 1e-300)  # never zero: an infinite residual goes to the last bin
        n = _added(moved.map(partial(part, steps=[*steps, (low, scale, None)])), np.add).reshape(len(leaves), MEDIAN_BINS)
        if rank is None:
            some, rank = n.sum(1) > 0, (n.sum(1) + 1) // 2
        upto = n.cumsum(1)
        chosen = (upto < rank[:, None]).sum(1).clip(0, MEDIAN_BINS - 1)
        left, at = n[np.arange(len(leaves)), chosen], np.arange(len(leaves))
        rank = rank - (upto[at, chosen] - left)
        steps.append((low, scale, chosen))
        if left.sum() <= MEDIAN_LEFT or len(steps) == MEDIAN_STEPS:
            break
        low, size = low + chosen * (size / MEDIAN_BINS), size / MEDIAN_BINS
    leaf, rest, n = _added(moved.map(partial(part, steps=steps)), _beside)
    out: list[float | None] = []
    for k in range(len(leaves)):
        of = np.flatnonzero(leaf == k)
        of = of[np.argsort(rest[of], kind="stable")]
        out.append(float(rest[of[np.searchsorted(n[of].cumsum(), rank[k])]]) if some[k] else None)
    return out


def _beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((a, b), axis=1)


# Gradient boosting -----------------------------------------------------------------------


@dataclass
class TreeModel:
    """A sum (or mean) of trees over the bins, for any number of targets at once."""

    bins: Bins
    targets: list[str]
    start: list[float]
    trees: list[Tree]
    scale: float = 1.0
    history: list[dict] = field(default_factory=list)

    def lookups(self) -> list[Lookup]:
        return [Lookup(t, np.array(t.value, float), self.bins.width) for t in self.trees]

    def margins(self, columns: Sequence[np.ndarray], lookups: list[Lookup] | None = None) -> np.ndarray:
        codes = self.bins.codes(columns)
        out, turned = np.zeros((len(codes), len(self.targets))), np.ascontiguousarray(codes.T)
        for t in self.lookups() if lookups is None else lookups:
            out += t(turned)
        return np.asarray(self.start) + out * self.scale

    def predict(self, df: DataFrame) -> DataFrame:
        """``{target}_hat`` columns, by Arrow batch; the model's size depends on its trees alone."""
        bare = TreeModel(self.bins, self.targets, self.start, [], self.scale)
        return _with_columns(df, self.bins.features, [f"{t}_hat" for t in self.targets], partial(bare.margins, lookups=self.lookups()))

    def importance(self) -> dict[str, float]:
        """Shares of the gain by feature."""
        total = np.zeros(len(self.bins.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return dict(zip(self.bins.features, map(float, total / total.sum() if total.sum() else total), strict=True))


def _with_columns(df: DataFrame, features: Cols, names: Cols, values) -> DataFrame:
    """``df`` with double columns ``names``: ``values`` of the feature columns, rows x names."""
    kept = [c for c in df.columns if c not in names]
    feats = [F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(features)]
    p = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = values([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[:p]])
            yield pa.RecordBatch.from_arrays([*b.columns[p:], *(pa.array(got[:, j]) for j in range(len(names)))], [*kept, *names])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for n in names:
        schema = schema.add(n, "double")
    return df.select(*feats, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


@dataclass
class Boosting:
    """Gradient boosted histogram trees for one or several targets.

    ``objective``: ``rmse`` (several targets share trees with vector leaves) or ``mae`` (leaves become the median of their
    residuals, as the gradients only have signs).  With ``valid`` given to ``fit``, the loss of those rows is measured after
    each round; training stops after ``patience`` rounds without a better one, and the model keeps the trees of the best.
    """

    objective: str = "rmse"
    rounds: int = 1000
    rate: float = 0.05
    leaves: int = 31
    depth: int = 64
    bins: int = 31
    l1: float = 0.0
    l2: float = 0.0
    rows: int = 20
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int | None = None
    seed: int = 42

    def params(self) -> dict:
        return dict(vars(self))

    def fit(self, df: DataFrame, features: Cols, targets: Cols, valid: Column | None = None) -> TreeModel:
        with small_batches(df.sparkSession):  # of blocks, each some hundred kilobytes
            return self._fit(df, features, targets, valid)

    def _fit(self, df: DataFrame, features: Cols, targets: Cols, valid: Column | None = None) -> TreeModel:
        if self.objective not in ("rmse", "mae"):
            raise ValueError(f"unknown objective: {self.objective}")
        if self.objective == "mae" and len(targets) > 1:
            raise ValueError("several targets share trees with the objective rmse only")
        train = df.filter(~F.coalesce(valid, F.lit(False))) if valid is not None else df
        bins = quantile_bins(train, features, self.bins)
        if self.objective == "mae":
            return self._fit_absolute(df, train, bins, targets[0], valid)
        data = blocks(df, bins, targets, valid)
        model = TreeModel(bins, list(targets), self._start(data, targets), [])
        penalty = Penalty(self.l1, self.l2, self.rows)
        pending: list[Tree] = []  # not yet in the blocks' margins
        stop = self.patience if valid is not None else None
        for k in range(self.rounds + 1):
            last = k == self.rounds
            features_ = self._features(len(bins.features), k)
            grown, losses = self._grow(data, model.start, pending, k, features_, penalty, last)
            if losses is None:
                return model  # no rows
            model.history.append(losses)
            if stop is not None and self._best(model.history) + stop <= k:
                break
            if grown is None:
                break
            model.trees.append(grown)
            pending.append(grown)
            if len(pending) == CUT and not last:
                data, pending = self._moved(data, pending), []
        if valid is not None:
            model.trees = model.trees[: self._best(model.history)]
        return model

    def _fit_absolute(self, df: DataFrame, train: DataFrame, bins: Bins, target: str, valid: Column | None) -> TreeModel:
        number = F.nanvl(F.col(f"`{target}`").cast("double"), F.lit(None))
        middle, rows = train.agg(F.percentile_approx(number, 0.5, 10_000), F.count(number)).first()
        model = TreeModel(bins, [target], [0.0 if middle is None else float(middle)], [])
        penalty, width = Penalty(self.l1, self.l2, self.rows), bins.width
        whole = cell_blocks(df, bins, target, valid, rows)
        moved, done = whole.map(partial(_moved_cells, start=model.start[0], trees=[])).persist(StorageLevel.MEMORY_AND_DISK), 0
        stop = self.patience if valid is not None else None
        known: list[Lookup] = []  # of the model's trees
        for k in range(self.rounds + 1):
            if k - done == CUT:
                newer, done = whole.map(partial(_moved_cells, start=model.start[0], trees=list(known))).persist(StorageLevel.MEMORY_AND_DISK), k
                newer.count()
                moved.unpersist()
                moved = newer
            pending = known[done:]
            features = self._features(len(bins.features), k)
            axes = _axes(features, width)
            signs = moved.mapPartitions(partial(_signs, pending=pending, sampled=partial(self._sampled, k=k))).persist(StorageLevel.MEMORY_AND_DISK)
            grower, losses, ends = Grower(self.leaves, self.depth), None, (0.0, 0.0)
            while names := grower.wanted():
                tree, at = grower.ahead(names)
                slot = Lookup(tree, _slots(tree, at, names), width)
                got = _added(signs.map(partial(_cell_sums, slot=slot, slots=len(names), axes=axes, width=width)), small=_short)
                if got is None or not got[0][1]:
                    moved.unpersist(), signs.unpersist()
                    return model  # no rows
                if losses is None:
                    mean = lambda s, n: float(s / n) if n else float("nan")
                    losses, ends = {"round": k, "train": mean(*got[0][:2]), "valid": mean(*got[0][2:4])}, got[2:]
                    if k == self.rounds:
                        break
                for name, sums in zip(names, got[1], strict=True):
                    grower.put(name, _marginals(sums, axes, features, width), penalty, features)
                    if axes and len(axes[0]) > 1 and (split := grower.known[name]) is not None and len(name) + 1 < self.depth:
                        for right in (False, True):
                            grower.put(f"{name}{right:d}", _marginals(sums, axes, features, width, split, right), penalty, features)
            signs.unpersist()
            model.history.append(losses)
            if k == self.rounds or stop is not None and self._best(model.history) + stop <= k or grower.known.get("") is None:
                break
            grown = grower.grown(penalty, self.rate)
            leaves = grown.below()[0]
            for leaf, rest in zip(leaves, _medians(moved, pending, grown, leaves, width, partial(self._sampled, k=k), ends), strict=True):
                if rest is not None:
                    grown.value[leaf] = [self.rate * rest]
            model.trees.append(grown)
            known.append(Lookup(grown, np.array(grown.value, float)[:, 0], width))
        moved.unpersist()
        if valid is not None:
            model.trees = model.trees[: self._best(model.history)]
        return model

    @staticmethod
    def _start(data: Blocks, targets: Cols) -> list[float]:
        """The mean of each target."""
        got = _pass(data, lambda valid, k, x, y, m: np.array([0.0] * (1 + y.shape[1])) if valid else np.array([len(y), *y.sum(0)]))
        return [0.0] * len(targets) if got is None or not got[0] else (got[1:] / got[0]).tolist()

    @staticmethod
    def _best(history: list[dict]) -> int:
        return min(range(len(history)), key=lambda k: (history[k]["valid"], k))

    def _features(self, p: int, k: int) -> list[int]:
        if self.feature_share >= 1:
            return list(range(p))
        return sorted(np.random.default_rng([self.seed, k]).choice(p, max(1, round(p * self.feature_share)), replace=False).tolist())

    def _sampled(self, hashes: np.ndarray, k: int) -> np.ndarray:
        if self.row_share >= 1:
            return np.ones(len(hashes), bool)
        x = hashes.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (k + 1 + self.seed)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) / 2.0**64 < self.row_share

    def _grow(self, data: Blocks, start: list[float], pending: list[Tree], k: int, features: list[int], penalty: Penalty, only_loss: bool) -> tuple[Tree | None, dict | None]:
        """The next tree, and the losses before it; no tree if the rows can't be split."""
        grower, losses, width, targets = Grower(self.leaves, self.depth), None, data.bins.width, data.targets
        while names := (grower.wanted() if not only_loss or losses is None else []):
            tree, at = grower.ahead(names)
            slot = _slots(tree, at, names)

            def task(valid: bool, hashes: np.ndarray, codes: np.ndarray, y: np.ndarray, m: np.ndarray, tree=tree, slot=slot, names=names) -> np.ndarray:
                apart = m + start + sum(t.values(codes) for t in pending) - y
                loss = (apart**2).sum()
                head = np.array([loss, apart.size, 0, 0] if not valid else [0, 0, loss, apart.size], float)
                if valid:
                    return np.concatenate((head, np.zeros(len(names) * len(features) * width * (targets + 2))))
                where = np.where(self._sampled(hashes, k), slot[tree.nodes(codes)], -1)
                hist = _histogram(codes, where, np.column_stack((apart, np.ones(len(y)), np.ones(len(y)))), len(names), features, width)
                return np.concatenate((head, hist.ravel()))

            got = _pass(data, task)
            if got is None or not got[1]:
                return None, None
            if losses is None:
                mean = lambda s, n: float(np.sqrt(s / n)) if n else float("nan")
                losses = {"round": k, "train": mean(*got[:2]), "valid": mean(*got[2:4])}
                if only_loss:
                    return None, losses
            for name, hist in zip(names, got[4:].reshape(len(names), len(features), width, targets + 2), strict=True):
                grower.put(name, hist, penalty, features)
        if grower.known.get("") is None:
            return None, losses
        return grower.grown(penalty, self.rate), losses

    @staticmethod
    def _moved(data: Blocks, trees: list[Tree]) -> Blocks:
        targets = data.targets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for valid, k, x, y, m in _opened(batches, targets):
                yield _block(valid, k, x, y, m + sum(t.values(x) for t in trees))

        return Blocks(durable(data.df.mapInArrow(run, _BLOCK)), data.bins, targets)


def boost_arrays(x: np.ndarray, y: np.ndarray, new: np.ndarray, learner: Boosting) -> np.ndarray:
    """The same boosting inside one task, for the rows of a window or fold: predictions (rows of ``new`` x columns of ``y``) after ``learner.rounds`` rounds.

    Bins come from the exact quantiles of ``x``; rows aren't sampled and leaves not renewed, so the objective is ``rmse``.
    """
    at = [k / learner.bins for k in range(1, learner.bins)] + [1.0]
    held = [c[~np.isnan(c)] for c in x.T]
    bins = Bins([str(k) for k in range(x.shape[1])], [np.unique(np.quantile(c, at, method="inverted_cdf"))[:-1] if len(c) else np.zeros(0) for c in held])
    codes, ahead = bins.codes(list(x.T)), bins.codes(list(new.T))
    start, ones, penalty = y.mean(0), np.ones(len(y)), Penalty(learner.l1, learner.l2, learner.rows)
    m, out = np.tile(start, (len(y), 1)), np.tile(start, (len(new), 1))
    for k in range(learner.rounds):
        grower, features = Grower(learner.leaves, learner.depth), learner._features(x.shape[1], k)
        sums = np.column_stack((m - y, ones, ones))
        while names := grower.wanted():
            tree, node = grower.ahead(names)
            hist = _histogram(codes, _slots(tree, node, names)[tree.nodes(codes)], sums, len(names), features, bins.width)
            for name, h in zip(names, hist, strict=True):
                grower.put(name, h, penalty, features)
        if grower.known.get("") is None:
            break
        grown = grower.grown(penalty, learner.rate)
        m, out = m + grown.values(codes), out + grown.values(ahead)
    return out


# Extremely randomised trees --------------------------------------------------------------


@dataclass
class ExtraTrees:
    """A mean of trees without bootstrap: one random cut for each of some features in each node, the best of these by variance gain.

    ``GROUP`` trees grow side by side in a pass, level by level.
    """

    trees: int = 100
    depth: int = 12
    bins: int = 64
    rows: int = 1
    feature_share: float = 1.0
    seed: int = 42
    GROUP = 8

    def params(self) -> dict:
        return dict(vars(self))

    def fit(self, df: DataFrame, features: Cols, targets: Cols) -> TreeModel:
        with small_batches(df.sparkSession):  # of blocks, each some hundred kilobytes
            return self._fit(df, features, targets)

    def _fit(self, df: DataFrame, features: Cols, targets: Cols) -> TreeModel:
        bins = quantile_bins(df, features, self.bins)
        data = blocks(df, bins, targets)
        model = TreeModel(bins, list(targets), [0.0] * len(targets), [])
        penalty, p, width = Penalty(rows=self.rows, curvature=0.0), len(bins.features), bins.width
        every = list(range(p))
        for first in range(0, self.trees, self.GROUP):
            group = {t: Grower(1 << 62, self.depth) for t in range(first, min(first + self.GROUP, self.trees))}
            while wanted := {t: n for t, g in group.items() if (n := g.wanted())}:
                order = [(t, n) for t in sorted(wanted) for n in wanted[t]]
                grown = {t: group[t].ahead(n) for t, n in wanted.items()}
                slots = {t: _slots(tree, at, wanted[t]) for t, (tree, at) in grown.items()}

                def task(valid: bool, hashes: np.ndarray, codes: np.ndarray, y: np.ndarray, m: np.ndarray, wanted=wanted, grown=grown, slots=slots) -> np.ndarray:
                    sums = np.column_stack((-y, np.ones(len(y)), np.ones(len(y))))
                    return np.concatenate([_histogram(codes, slots[t][grown[t][0].nodes(codes)], sums, len(wanted[t]), every, width).ravel() for t in sorted(wanted)])

                got = _pass(data, task)
                if got is None:
                    return model
                for (t, name), hist in zip(order, got.reshape(len(order), p, width, data.targets + 2), strict=True):
                    draw = np.random.default_rng([self.seed, t, int("1" + name, 2)])
                    some = every if self.feature_share >= 1 else sorted(draw.choice(p, max(1, round(p * self.feature_share)), replace=False).tolist())
                    group[t].put(name, hist[some], penalty, some, draw)
            model.trees += [g.grown(penalty, 1.0) for g in group.values()]
            model.scale = 1 / len(model.trees)
        return model


# Boosted stumps --------------------------------------------------------------------------


@dataclass
class StumpModel:
    """Weighted votes of stumps; ``prediction`` is 0 or 1, ``probability`` of 1 by the logistic of twice the margin."""

    bins: Bins
    label: str
    stumps: list[tuple[int, int, int, float]]  # feature, cut, vote up to it, weight
    history: list[float] = field(default_factory=list)

    def margin(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for f, cut, vote, weight in self.stumps:
            out += weight * np.where(codes[:, f] <= cut, vote, -vote)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        def values(columns: Sequence[np.ndarray]) -> np.ndarray:
            m = self.margin(self.bins.codes(columns))
            return np.column_stack(((m > 0).astype(float), 1 / (1 + np.exp(-2 * np.clip(m, -300, 300)))))

        return _with_columns(df, self.bins.features, ["prediction", "probability"], values)

    def importance(self) -> dict[str, float]:
        total = np.zeros(len(self.bins.features))
        for f, _, _, weight in self.stumps:
            total[f] += weight
        return dict(zip(self.bins.features, map(float, total / total.sum() if total.sum() else total), strict=True))


@dataclass
class AdaBoost:
    """Discrete boosting of stumps for labels 0 and 1: a row's weight is the exponential of its margin so far, one pass a round.

    A missing value counts as below every cut. Training ends early when a stump makes no error or does no better than chance.
    """

    rounds: int = 50
    bins: int = 64
    rate: float = 1.0

    def params(self) -> dict:
        return dict(vars(self))

    def fit(self, df: DataFrame, features: Cols, label: str) -> StumpModel:
        with small_batches(df.sparkSession):  # of blocks, each some hundred kilobytes
            return self._fit(df, features, label)

    def _fit(self, df: DataFrame, features: Cols, label: str) -> StumpModel:
        bins = quantile_bins(df, features, self.bins)
        data = blocks(df, bins, [label])
        model = StumpModel(bins, label, [])
        p, width = len(bins.features), bins.width
        every = list(range(p))
        for _ in range(self.rounds):
            shift = sum(abs(s[3]) for s in model.stumps)  # so that no weight overflows

            def task(valid: bool, hashes: np.ndarray, codes: np.ndarray, y: np.ndarray, m: np.ndarray, shift=shift) -> np.ndarray:
                sign = np.where(y[:, 0] > 0.5, 1.0, -1.0)
                w = np.exp(-sign * model.margin(codes) - shift)
                return _histogram(codes, np.zeros(len(y), np.int64), np.column_stack((w * (sign > 0), w * (sign < 0))), 1, every, width).ravel()

            got = _pass(data, task)
            if got is None or not got.sum():
                break
            below = np.cumsum(got.reshape(p, width, 2), axis=1)
            total = below[0, -1]
            # The error of the vote +1 up to each cut: negatives below, positives above.
            error = (below[:, :, 1] + total[0] - below[:, :, 0]) / total.sum()
            either = np.minimum(error, 1 - error)
            f, cut = np.unravel_index(int(np.argmin(np.round(either, 12))), either.shape)
            e, vote = float(either[f, cut]), 1 if error[f, cut] <= 0.5 else -1
            if e >= 0.5 - 1e-12:
                break
            model.history.append(e)
            model.stumps.append((int(f), int(cut), vote, self.rate * 0.5 * float(np.log((1 - max(e, 1e-10)) / max(e, 1e-10)))))
            if e <= 1e-10:
                break
        return model


# Models as tables ------------------------------------------------------------------------


def save(model: TreeModel | StumpModel, spark: SparkSession, path: str) -> None:
    """The model as a table of one row of JSON for its head and one for each tree."""
    if isinstance(model, TreeModel):
        head = {"kind": "trees", "features": model.bins.features, "edges": [e.tolist() for e in model.bins.edges], "targets": model.targets, "start": model.start, "scale": model.scale, "history": model.history}
        parts = [vars(t) for t in model.trees]
    else:
        head = {"kind": "stumps", "features": model.bins.features, "edges": [e.tolist() for e in model.bins.edges], "label": model.label, "history": model.history}
        parts = [list(s) for s in model.stumps]
    rows = [(k, json.dumps(v)) for k, v in enumerate([head, *parts])]
    spark.createDataFrame(rows, "at int, part string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> TreeModel | StumpModel:
    head, *parts = (json.loads(r["part"]) for r in sorted(spark.read.parquet(path).collect(), key=lambda r: r["at"]))  # a row a tree
    bins = Bins(head["features"], [np.array(e, float) for e in head["edges"]])
    if head["kind"] == "trees":
        return TreeModel(bins, head["targets"], head["start"], [Tree(**t) for t in parts], head["scale"], head["history"])
    return StumpModel(bins, head["label"], [tuple(s) for s in parts], head["history"])

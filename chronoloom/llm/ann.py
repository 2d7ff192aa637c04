"""Nearest neighbours by inner product with randomly rotated codes.

Vectors are rotated by a random orthogonal matrix and centred; a code keeps BITS bits of
each coordinate, the first of them its sign, on a grid as wide as the vector's largest
coordinate, and two scalars: the grid's step and the length of what the code leaves out.
The inner product with a query is estimated from the code; it is off by at most the query's
length times the length left out, and rounding.  A candidate is reranked on the original
vectors, in double precision, if its upper bound reaches the k-th largest lower bound of its
block; so no neighbour is lost.  Every query meets the code of every row: that work grows
with the product of both, reranking only with the queries and blocks.

Query rows meet candidate rows in blocks: both are dealt into blocks of at most about
BLOCK rows, each pair of blocks is one group, and a group returns at most k candidates
for each query; the best k of all blocks are the result.

Defined results: rows with a null id or vector, a zero vector or null or non-finite
components take no part, nor do rows of another length than the most common one (the
smaller length on ties); of rows with equal ids the one with the smallest vector counts;
ties go to the smaller id; a query with fewer candidates gets all; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, require

K, EVERY, BLOCK, BITS, SEED = 20, 20, 8192, 8, 5
#: Queries compared at once, and pairs reranked at once.
BATCH, RERANK = 256, 1 << 16


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of vectors around a centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        half = 1 << (BITS - 1)
        apart = (x - centre) @ turn
        step = np.abs(apart).max(1) / half
        at = np.floor(apart / np.where(step > 0, step, 1)[:, None]).clip(-half, half - 1) + 0.5
        left = np.linalg.norm(apart - at * step[:, None], axis=1)
        length = np.linalg.norm(at, axis=1) * step
        # Rounding: of a product in single precision, and of centring and turning in double precision.
        self.off = (left * (1 + 1e-6) + (x.shape[1] + 16) * 2.0**-23 * length + 1e-12 * (np.linalg.norm(x, axis=1) + np.linalg.norm(centre)) + 1e-37).astype(np.float32)
        self.at, self.step, self.turn = at.astype(np.float32), step.astype(np.float32), turn

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x codes) of inner products, less that with the centre, for queries of length one."""
        unit = (queries @ self.turn) / np.linalg.norm(queries, axis=1)[:, None]
        guess = unit.astype(np.float32) @ self.at.T
        guess *= self.step
        low = guess - self.off
        guess += self.off
        return low, guess

    def candidates(self, queries: np.ndarray, skip: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, row) that may be among a query's k nearest; skip: its own row, or -1."""
        low, high = self.bounds(queries)
        own = np.flatnonzero(skip >= 0)
        low[own, skip[own]] = -np.inf
        n = low.shape[1]
        floor = np.partition(low, n - min(k, n), axis=1)[:, n - min(k, n)]
        maybe = ~(high < floor[:, None])  # what has no bounds is kept
        maybe[own, skip[own]] = False
        return np.nonzero(maybe)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine: Column = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).dropna().filter(fine & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (sizes[0] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every other row for each row where ``is_query`` (a condition on vec_id)."""
    require(vectors, id_col, vec_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = durable(usable(vectors, id_col, vec_col))
    total, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    dim = (rows.select(F.size("v")).first() or [1])[0]
    # The centre: the mean vector, one aggregate over all rows.
    centre = np.array([r[1] for r in rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x")).orderBy("i").collect()] or [0.0])
    turn = rotation(dim)
    cand, quer = max(1, -(-total // BLOCK)), max(1, -(-asked // (BLOCK // 2)))
    block = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.filter(is_query).select(block(1, quer).alias("qb"), every(cand).alias("cb"), "vec_id", "v")
    right = rows.select(every(quer).alias("qb"), block(2, cand).alias("cb"), "vec_id", "v")

    def near(q: pa.Table, c: pa.Table) -> pa.Table:
        kind = c.schema.field("vec_id").type
        out: list[list[np.ndarray]] = [[], [], []]
        if q.num_rows and c.num_rows:
            qi, ci = (np.array(t.column("vec_id")) for t in (q, c))
            qx, cx = (np.array(t.column("v").combine_chunks().flatten()).reshape(-1, dim) for t in (q, c))
            codes = Codes(cx, centre, turn)
            order = np.argsort(ci)
            place = np.searchsorted(ci[order], qi).clip(max=len(ci) - 1)
            skip = np.where(ci[order][place] == qi, order[place], -1)
            for at in range(0, len(qi), BATCH):
                r, c = codes.candidates(qx[at : at + BATCH], skip[at : at + BATCH], k)
                exact = np.empty(len(r))
                for i in range(0, len(r), RERANK):
                    j = slice(i, i + RERANK)
                    exact[j] = np.cumsum(cx[c[j]] * qx[at + r[j]], axis=1)[:, -1]  # summed in order, so the same in any block
                first = np.lexsort((ci[c], -exact, r))
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                first = first[rank < k]
                out[0].append(qi[at + r[first]])
                out[1].append(ci[c[first]])
                out[2].append(exact[first])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("query_id", "vec_id", "score"), out, (kind, kind, pa.float64()), strict=True)})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(near, f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)

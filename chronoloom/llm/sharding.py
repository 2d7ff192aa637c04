"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of each row.  A bucket whose rows
exceed the byte limit splits on the next bit, others stay; so every shard has the least
depth at which it fits.  The directory is worked out level by level on aggregated
bytes: only what is still too large is looked at again, with STEP more bits each time.

The hash is MD5 over the id and the text, followed by bits of the row's position, which
matter only to rows that are equal in both; so copies of one row, however many, split
too.  A single row above the limit gets a shard of its own, marked ``oversized``.

Defined results: null ids and texts hash as themselves and a null text weighs nothing;
an empty table has no shards; repeated rows are rows of their own; further columns are
ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, fresh, require

LIMIT, STEP = 16 << 20, 8
#: Bits of the id and text, then of the position.
CONTENT, BITS = 56, 96


def hash_bits() -> Column:
    """The row's hash as a string of bits; copies of a row share the first CONTENT."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N"))
    content = F.md5(F.concat(doc, F.lit("\n"), F.coalesce(F.md5(F.col("text")), F.lit("\\N"))))
    place = F.md5(F.col("_place").cast("string"))
    bits = lambda h, a, n: F.lpad(F.conv(F.substring(h, a, n), 16, 2), 4 * n, "0")
    return F.concat(bits(content, 1, 7), bits(content, 8, 7), bits(place, 1, 10))


def directory(keys: DataFrame, limit: int, bits: int = BITS) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows, oversized): the leaves, from rows (bits, size)."""
    leaves = []
    depth, open_ = 0, keys.select("bits", "size", F.lit(1).alias("n"))
    while True:
        step = min(STEP, bits - depth)
        cell = F.substring("bits", 1, depth + step)
        cells = open_.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        # One row for each cell and each level above it; a level's sums tell whether it had to split.
        levels = F.explode(F.sequence(F.lit(depth), F.lit(depth + step)))
        node = cells.select("cell", "size", "n", levels.alias("depth"))
        node = node.groupBy(F.expr("substring(cell, 1, depth)").alias("shard"), "depth").agg(F.sum("size").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        node = durable(node.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == bits)))
        split = node.filter(~F.col("fits")).select(F.col("shard").alias("up"), (F.col("depth") + 1).alias("down"))
        below = node.join(split, (node["depth"] == split["down"]) & (F.expr("substring(shard, 1, depth - 1)") == split["up"]), "left_semi")
        root = node.filter(F.col("depth") == depth) if depth == 0 else None
        tops = below if root is None else below.unionByName(root)
        leaves.append(tops.filter("fits").drop("fits"))
        depth += step
        rest = node.filter((F.col("depth") == depth) & ~F.col("fits")).select(F.col("shard").alias("up"))
        if depth >= bits or rest.isEmpty():
            break
        open_ = durable(open_.join(rest, F.substring("bits", 1, depth) == rest["up"], "left_semi"))
    found = reduce(DataFrame.unionByName, leaves)
    return found.withColumn("oversized", F.col("shard_bytes") > limit)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, shard (its bits, empty for the root), depth, shard_bytes, shard_rows, oversized for each row."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_place", F.monotonically_increasing_id())
    keys = durable(rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), hash_bits().alias("bits")))
    leaves = durable(directory(keys, limit))
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1
    if not depths:
        return keys.join(leaves.withColumn("bits", F.lit("")), "bits").select("doc_id", "size", "shard", "depth", "shard_bytes", "shard_rows", "oversized")
    # A row's shard is the one leaf that is a prefix of its bits.
    tried = keys.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))).withColumn("shard", F.expr("substring(bits, 1, depth)"))
    return tried.join(leaves, ["depth", "shard"]).select("doc_id", "size", "shard", "depth", "shard_bytes", "shard_rows", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> str:
    """Write the rows with all their columns, a folder for each shard; returns the name of the folders' column: "shard", longer if ``docs`` has that.

    No shard exceeds the limit but one of a single row; copies of a row are dealt by position.
    """
    require(docs, "doc_id", "text")
    shard = fresh(docs, "shard")
    place = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_place"))
    # Positions must be the same when shards are sized and when they are written.
    rows = durable(place.select("row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), hash_bits().alias("bits")))
    leaves = durable(directory(rows.select("bits", "size"), limit)).select("depth", "shard")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()] or [0]  # at most BITS + 1
    tried = rows.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))).withColumn("shard", F.expr("substring(bits, 1, depth)"))
    dealt = tried.join(leaves, ["depth", "shard"]).select(*[F.col("row")[c].alias(c) for c in docs.columns], F.concat(F.lit("s"), "shard").alias(shard))
    dealt.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)
    return shard


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", F.concat(F.lit("s"), "shard").alias("shard"), "depth", "shard_bytes", "oversized")


OP6_SQL = r"""
WITH RECURSIVE k AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || chr(10) || coalesce(md5(text), '\N')) AS h FROM documents),
b AS (SELECT doc_id, size, lpad(bin(CAST('0x' || substr(h, 1, 7) AS BIGINT)), 28, '0') || lpad(bin(CAST('0x' || substr(h, 8, 7) AS BIGINT)), 28, '0') AS bits FROM k),
t AS (
  SELECT doc_id, size, bits, 0 AS depth, CAST(sum(size) OVER () AS BIGINT) AS shard_bytes, count(*) OVER () AS n FROM b
  UNION ALL
  SELECT doc_id, size, bits, depth + 1, CAST(sum(size) OVER (PARTITION BY substr(bits, 1, depth + 1)) AS BIGINT), count(*) OVER (PARTITION BY substr(bits, 1, depth + 1))
  FROM t WHERE shard_bytes > 16777216 AND n > 1 AND depth < 56)
SELECT doc_id, CAST(size AS BIGINT) AS size, 's' || substr(bits, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, shard_bytes, shard_bytes > 16777216 AS oversized
FROM t WHERE shard_bytes <= 16777216 OR n = 1 OR depth = 56
"""

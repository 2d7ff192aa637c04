"""Shared pieces of the corpus operators: durable lineage cuts and tokenisation columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The same mapping for UTF-8 bytes.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: A table is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 32 << 20


#: Bytes of an Arrow batch of whole texts; a worker holds a batch and what it makes of it.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only on a single machine that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="shared-")).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def light_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES; plans read it when they run, so the caller restores it (``own_batches``)."""
    set_ = spark.conf.get(_BATCH).removesuffix("b")
    if not set_.isdigit() or int(set_) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def own_batches(spark: SparkSession) -> Iterator[None]:
    """Whatever is set inside, the session has its own limit again afterwards."""
    before = spark.conf.get(_BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if ``rows`` rows of ``row_bytes`` stay below BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

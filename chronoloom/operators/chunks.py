"""Time chunks for long series, so that one series doesn't have to pass through one task; and kernels over many short ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def chunked(df: DataFrame, time: str, size: int, before: int) -> DataFrame:
    """Rows with ``chunk`` (of ``size`` seconds) and ``own``; a row in the last ``before`` seconds of a chunk also opens the next one, not as its own.

    On a regular grid, windows over rows of at most ``before`` seconds back, partitioned by series and chunk, then give every own row what windows over the whole series would.
    """
    if before > size:
        raise ValueError("the overlap is longer than a chunk")
    s = F.unix_seconds(F.col(time).cast("timestamp"))
    home = F.floor(s / size)
    to = F.when(s % size >= size - before, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumns({"chunk": F.explode(to)}).withColumn("own", F.col("chunk") == home)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("chunk", "own")


def each_series(df: DataFrame, by: Sequence[str], order: str, column: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], out: str) -> DataFrame:
    """``df`` with the columns ``out`` that ``kernel`` makes of each series' values in order.

    The rows of a partition stream through in order of the series, and a batch's whole series are served at once: a group for each
    series would cost some ten milliseconds, more than most kernels take.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(order))) == 1
    rows = df.select(first.alias("_first"), F.col(column).cast("double").alias("_y"), *[F.col(f"`{c}`") for c in df.columns])
    schema = StructType([*df.schema.fields, *StructType.fromDDL(out).fields])

    def served(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            y = np.array(b.column(1).to_numpy(zero_copy_only=False), float)
            at = [*np.flatnonzero(b.column(0).to_numpy(zero_copy_only=False)), len(y)]
            got = [kernel(y[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            made = [pa.array(np.concatenate([g[c] for g in got])) for c in got[0]]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], [*b.schema.names[2:], *got[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column(0).to_numpy(zero_copy_only=False))
            if len(starts):
                if held or starts[-1]:
                    yield from served([*held, b.slice(0, starts[-1])])
                held, b = [], b.slice(starts[-1])
            held.append(b)
        if held:
            yield from served(held)

    return rows.mapInArrow(run, schema)

"""Readers and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that any store it reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    """With an explicit schema; a column list is pruned at the scan."""
    df = spark.read.csv(path, schema=schema, header=header, sep=sep)
    return df.select(*columns) if columns else df


def read_bundle(spark: SparkSession, target: str, optional: dict[str, str], fmt: str = "parquet", schemas: dict[str, StructType | str] | None = None) -> dict[str, DataFrame]:
    """``target_series`` (an error if missing) and those optional tables that exist."""
    def load(name: str, path: str) -> DataFrame:
        schema = (schemas or {}).get(name)
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)

    if not exists(spark, target):
        raise FileNotFoundError(target)
    found = {"target_series": load("target_series", target)}
    return found | {name: load(name, path) for name, path in optional.items() if exists(spark, path)}


def read_labelled_tsv(spark: SparkSession, path: str, n_features: int, weights: str | None = None) -> DataFrame:
    """Headerless: ``label`` and ``f0`` ..; a weight file has one number for each line."""
    schema = ", ".join(["label double", *[f"f{i} double" for i in range(n_features)]])
    df = spark.read.csv(path, schema=schema, sep="\t")
    if not weights:
        return df
    numbered = lambda d: d.rdd.zipWithIndex().map(lambda r: (r[1], *r[0])).toDF(["_n", *d.columns])  # noqa: E731  line numbers need the files' order
    return numbered(df).join(numbered(spark.read.csv(weights, schema="weight double")), "_n").drop("_n")


def read_csv_with_units(spark: SparkSession, path: str, columns: Sequence[str], time: str, renames: dict[str, str] | None = None) -> DataFrame:
    """A CSV whose row after the header holds units: rows whose time doesn't parse go, the rest become numbers."""
    raw = spark.read.csv(path, header=True)
    t = F.expr(f"try_cast(`{time}` AS timestamp_ntz)")
    out = raw.select(t.alias("time"), *[F.expr(f"try_cast(`{c}` AS double)").alias((renames or {}).get(c, c)) for c in columns])
    return out.filter(F.col("time").isNotNull())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_once(df: DataFrame, path: str) -> None:
    """Only if there is nothing yet."""
    df.write.mode("ignore").parquet(path)


def plot_frame(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a plot needs: actual and predicted values side by side by time."""
    return actual.join(predicted, list(keys), "full").orderBy(*keys)

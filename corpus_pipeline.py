"""A training-data pipeline over ``documents``: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontam, nearjaccard, quality, secrets
from chronoloom.llm.common import light_batches, own_batches, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go."""
    light_batches(spark)
    ranker = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return quality.with_score(docs, ranker).filter(F.col("quality_score") >= quality.THRESHOLD).select(*names)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: SimHash links verified by five-word Jaccard similarity of at least 0.8, completed to all such pairs."""
    light_batches(spark)
    return nearjaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    light_batches(spark)
    return secrets.redact(docs, secrets.learn(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, from which its text can be decoded."""
    light_batches(spark)
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifier, the fingerprints and the inferred formats have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the folders of the stages before it are removed once they are read, and the session's settings are as before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with own_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs

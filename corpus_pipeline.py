"""The corpus pipeline: each stage takes the documents that its predecessor kept, written as Parquet and reread.

A stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from portcullis.llm import quality_gam
from portcullis.llm.bag_minhash import drop_near
from portcullis.llm.byte_bpe import round_trip
from portcullis.llm.common import checkpoint_folder, fold, table
from portcullis.llm.decontaminate import drop_leaks
from portcullis.llm.exact_dedup import drop_copies

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all documents' labels outside its held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = quality_gam.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality_gam.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number and digest of each text's ids, and the digest of what they decode to."""
    return round_trip(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A corpus pipeline of five stages: classify, drop near copies, decontaminate, redact secrets, pack.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomstat.llm import classifier, decontaminate, packing, secrets, simhash
from loomstat.llm.shared import checkpoint_folder, read, remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic. Each row is judged by itself, also one with nulls or that is there twice."""
    return classifier.classify(docs, read(spark, sf_dir, "labels"), scores=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, and all documents in no group.

    Of rows that repeat, by id or without one, one row of each text stays; texts that are null or have no words all stay.
    """
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows of one id are one document; rows without an id are told apart by their texts."""
    return decontaminate.cleaned(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets replaced; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and where each lies in its sequence; each row is packed, one without words has no piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]
#: SQL can't express training, fingerprints or packing; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; what stages write lies in the checkpoint folder, until the next stage is written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

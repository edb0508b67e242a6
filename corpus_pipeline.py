"""A training-data pipeline over ``documents``: toxicity, quality, near-duplicates, secrets, packing.

Each stage reads all that the one before kept; its result is written as Parquet
and read again as the next one's input.  Rejected documents go, secrets are
replaced in the texts, and the last stage packs what is left into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldtally.llm import near, packing, quality, secrets, toxicity
from fieldtally.llm.common import shared_folder
from fieldtally.llm.queries import tokenizer_file


#: Rows that go to a Python worker at a time: documents are long, and a batch of them is held several times over.
BATCH_ROWS = 250
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what a worker of a small executor can hold."""
    if not 0 < int(spark.conf.get(BATCHES)) <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality.keep_good(docs, _labels(spark, sf_dir))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return near.keep_one(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return secrets.redact(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]

#: Classifiers and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them is kept in the shared folder that spark.checkpoint.dir names."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            path = f"{shared}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCHES, before)  # the session's own size of batches
    return docs

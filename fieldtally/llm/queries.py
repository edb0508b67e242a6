"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, chat, langid, licenses, negatives, packing, quality, resampling, secrets, simhash, sketch, sql, toxicity
from .common import crc_remainder, documents


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _scored(docs: DataFrame, score, modulus: int, remainder: int, threshold: float) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(crc_remainder("doc_id", modulus) == remainder, F.lit(False)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, quality.quality_score(model, F.col("text")), quality.MODULUS, quality.HELD_OUT, quality.THRESHOLD)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", audio.audio_digest(F.col("text")).alias("a")).select("doc_id", "a.*")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", secrets.secret_digest(F.col("text")).alias("s")).select("doc_id", "s.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    digest = bpe.round_trip_digest(F.col("text"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return documents(spark, sf_dir).select("doc_id", digest.alias("b")).select("doc_id", "b.*")


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, toxicity.toxicity_score(model, F.col("text")), toxicity.MODULUS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=moved)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train_languages(docs)
    rows = docs.select("doc_id", F.coalesce(crc_remainder("doc_id", langid.MODULUS) == langid.HELD_OUT, F.lit(False)).alias("held_out"), langid.language(model, F.col("text")).alias("l"))
    return rows.select("doc_id", "held_out", "l.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_packing, op2_chat, op3_quality, op4_simhash, op5_audio, op6_licenses, op7_secrets, op8_bpe, op9_sketch, op10_toxicity, op11_resampling, op12_hard_negatives, op13_language)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

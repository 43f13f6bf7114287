"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, chat_format, decontaminate, fingerprints, language_id, language_model, near_dedup, oracles, secret_scan, span_dedup, token_files

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    """The default file of the tokenizer queries; each operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.digests(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.digests(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(documents(spark, sf_dir), vocabulary())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(turns.unionByName(more))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digests(documents(spark, sf_dir))


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op1 find, without the network's findings."""
    return op1_secret_scan(spark, sf_dir).drop("spans", "n_cnn", "n_likely")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that come from the table of words."""
    return op4_language_model(spark, sf_dir).drop("score", "bits_per_byte").withColumn("base_score", F.round("base_score", 6))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts op8 compares."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_span_dedup": op2_span_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_model": op4_language_model,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "secret_rules": secret_rules,
    "word_scores": word_scores,
    "edited_texts": edited_texts,
}
SQL: dict[str, str] = oracles.SQL

"""A training corpus from raw documents: known language, one of each group of near copies, no benchmark text, no secrets, tokens.

Each stage takes the documents that the stage before it kept, written as Parquet
and read again, and works on all of them. All but the last return documents'
columns; the last returns ids and counts of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontaminate, language_id, near_dedup, secret_scan
from spindrift.llm.common import forget, stored
from spindrift.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts."""
    return language_id.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near duplicates."""
    return near_dedup.drop_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up less than a twentieth."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), vocabulary(), exact="exact")
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_tokens"), "exact", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", uncontaminated),
    ("secret_scan", without_secrets),
    ("bpe", tokens),
]
#: Language identification, the secret network and encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            forget(last)
        last = docs
    return docs

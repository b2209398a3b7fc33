"""A training-corpus pipeline over `documents`: five stages, each one operator of aislemetry.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislemetry.llm import bpe, compression, mixing, orderminhash, pii
from aislemetry.llm.common import table
from aislemetry.llm.queries import tokenizer_file
from aislemetry.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules accept."""
    return compression.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each near-duplicate class."""
    return orderminhash.one_per_class(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars follows the new text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says: none, once or several times."""
    return mixing.apply(docs, table(spark, sf_dir, "labels"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every row; `decoded` is the text that the ids stand for."""
    return bpe.encode(docs, tokenizer_file(), keep=("doc_id", "lang", "source"),
                      wanted=("n_tokens", "ids_sha256", "ids", "decoded"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mask_personal_data", mask_personal_data),
          ("mix_sources", mix_sources), ("tokenize", tokenize)]

# Compression ratios and sampled minima have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    return docs

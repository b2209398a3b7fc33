"""Registered queries of the operators in this folder, each over its whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.llm import (bpe, compression, digest, divergence, langid, lexical, licenses, mixing, orderminhash, pii, quality,
                            token_rollup, toxicity)
from aislemetry.llm.common import table
from aislemetry.session import cut, shared_dir


def tokenizer_file(name="word_bpe_49k.json") -> str:
    """A file of the public tokenizer collection that is installed beside Spark."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the least doc_id of the near-duplicate class."""
    return orderminhash.label_documents(table(spark, sf_dir, "documents"), keep=("doc_id",))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.measure(table(spark, sf_dir, "documents"))


def op10_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, one posterior per domain, rate, copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return mixed.select("doc_id", "n_tokens", *[F.element_at("p", d + 1).alias(f"p_{name}") for d, name in enumerate(
        mixing.DOMAINS)], "rate", "copies")


def op8_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file())


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(table(spark, sf_dir, "documents"))


def op2_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_family_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, one of them committed twice.

    All documents come in under words-1; those outside English are re-tokenised; labelled toxic ones are deleted.
    """
    numbers = cut(token_rollup.measured(table(spark, sf_dir, "documents"), keep=("doc_id",)))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    foreign = F.coalesce("lang", F.lit("")) != "en"
    ledger = token_rollup.Ledger(spark, shared_dir(spark, "rollup"))
    ledger.commit("insert", token_rollup.signed(numbers, "words-1"))
    ledger.commit("revise", token_rollup.moved(numbers.where(foreign), "words-1", "pieces-2"))
    ledger.commit("delete", token_rollup.signed(numbers.join(toxic, "doc_id", "left_semi"), F.when(
        foreign, "pieces-2").otherwise("words-1"), -1))
    ledger.commit("revise", token_rollup.moved(numbers.where(foreign), "words-1", "pieces-2"))
    return ledger.totals(["insert", "revise", "delete"])


def op11_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.Index.build(table(spark, sf_dir, "documents")).rank(table(spark, sf_dir, "benchmark"))


def op13_bitmap_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op7_order_minhash, op9_compression_bands, op10_lstm_crf_pii, op4_soft_mixing, op8_streaming_bpe, op1_quartile_digest, op2_fourier_quality,
                                 op3_toxic_segments, op5_family_langid, op6_token_rollup,
                                 op11_template_licenses, op12_hybrid_search, op13_bitmap_divergence)}
ORACLES: dict[str, str] = {"op6_token_rollup": r"""
with kept as (
    select d.source, d.lang, case when coalesce(d.lang, '') <> 'en' then 'pieces-2' else 'words-1' end as version,
           coalesce(d.text, '') as text
    from documents d
    where d.doc_id is null or d.doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null))
select source, lang, version, count(*) as n_docs,
       cast(sum(case version
           when 'words-1' then len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
           else len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) end) as bigint) as n_tokens
from kept group by all""",
    "op11_template_licenses": licenses.oracle(), "op12_hybrid_search": lexical.oracle(),
    "op13_bitmap_divergence": divergence.oracle()}

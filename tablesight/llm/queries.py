"""The registered queries of the corpus operators, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesight.llm import (bootstrapped_pii, byte_bpe, byte_gru, classifier_chain, decontaminate, filter_audit,
                            length_histogram, markov_secrets, ngram_perplexity, shuffle_shards, simhash_pivots,
                            va_file, warc_zip)
from tablesight.llm import sql as SQL
from tablesight.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits text before merging."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier_chain.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_gru.languages(table(spark, sf_dir, "documents"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards.document_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.scan(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), *vocabulary(),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op6_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_perplexity.quality(table(spark, sf_dir, "documents"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), *vocabulary(), outputs=("n_tokens",), keep=[])
    return length_histogram.length_histogram(lengths)


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrapped_pii.scan(table(spark, sf_dir, "documents"))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.cluster_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.page_archives(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_classifier_chain, op2_byte_gru, op3_feistel_shards, op4_markov_secrets, op5_byte_bpe,
    op6_ngram_perplexity, op7_length_histogram, op8_simhash_pivots, op9_bootstrapped_pii,
    op10_qgram_decontamination, op11_filter_interactions, op12_va_file_clusters, op13_warc_packages)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_interactions": SQL.filter_interactions(), "op12_va_file_clusters": SQL.centroid_clusters(),
            "op13_warc_packages": SQL.page_records()}

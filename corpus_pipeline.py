"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Language ID drops documents it rejects, SimHash keeps one document of each
near-duplicate class, decontamination drops documents that leak a benchmark
item, the secret scan replaces secrets in the text, and the last stage encodes
the texts to token ids.  Every stage but the last returns the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.llm import byte_bpe, byte_gru, decontaminate, markov_secrets, simhash_pivots
from tablesight.llm import queries as Q
from tablesight.llm.common import packed, table
from tablesight.session import scratch_table

#: Least document probability of the predicted language.  Far below what even a
#: few words of one language get, it rejects text that looks like none of them.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (``und``) or without a likely one."""
    model = byte_gru.train(byte_gru.training_windows(docs))
    labelled = byte_gru.with_language(packed(docs, "text"), model, keep=["__doc"])
    kept = (F.col("lang_pred") != byte_gru.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return labelled.filter(kept).select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of every SimHash class."""
    return simhash_pivots.one_per_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; n_chars follows the text."""
    clean = markov_secrets.redacted(docs, markov_secrets.train_on(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of what they decode to."""
    return byte_bpe.encode_documents(
        docs, *Q.vocabulary(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"),
        keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch_table(docs, name)
    return docs

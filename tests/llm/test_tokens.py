"""Byte-level BPE (5) and length histogram (7) against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesight.llm import byte_bpe, length_histogram
from tablesight.llm import queries as Q

PATH, PATTERN = Q.vocabulary()


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.PieceEncoder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(PATH)), PATTERN)


def expected(exact, text):
    ids = exact.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stre09é<|>")), max_size=60))
def test_ids_equal_the_tiktoken_library(exact, encoder, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == exact.encode_ordinary(text)


def test_special_token_strings_are_ordinary_text(exact, encoder):
    assert np.frombuffer(encoder.encode(["<|endoftext|>"])[0], "<u4").tolist() == exact.encode_ordinary("<|endoftext|>")


def test_query_on_edge_rows(spark, edge_docs, exact, tmp_path):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op5_byte_bpe(spark, str(tmp_path)).collect())
    assert got == sorted(expected(exact, r.text) for r in edge_docs.collect())


def test_query_on_documents(spark, sf_small, small_docs, exact):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op5_byte_bpe(spark, sf_small).collect()}
    assert got == {r.doc_id: expected(exact, r.text) for r in small_docs.collect()}


def test_offsets_cover_split_characters_and_decode_round_trip(spark, edge_docs):
    clash = edge_docs.withColumn("IDS", F.lit("taken")).withColumn("__text_of_row", F.lit(1))
    rows = byte_bpe.encode_documents(clash, PATH, PATTERN, outputs=("ids", "starts", "ends", "decoded"))
    assert "IDS" not in rows.columns and "__text_of_row" in rows.columns
    for r in rows.filter("length(text) < 1000").collect():
        table = byte_bpe.token_bytes(byte_bpe.read_ranks(PATH))
        assert bytes(r.decoded).decode() == r.text
        for i, a, b in zip(r.ids, r.starts, r.ends):
            assert table[i] in r.text[a:b].encode()
    back = byte_bpe.decode_documents(rows.select("doc_id", "ids"), PATH)
    assert sorted(x.text for x in back.collect()) == sorted(r.text or "" for r in edge_docs.collect())
    cut = spark.createDataFrame([([i],) for i in byte_bpe.PieceEncoder(
        byte_bpe.tokenizer_json(byte_bpe.read_ranks(PATH)), PATTERN).tokenizer.encode("\U0001F600").ids] + [(None,)], "ids array<int>")
    assert [r.text for r in byte_bpe.decode_documents(cut, PATH).collect()][-1] is None


def test_empty_table(no_docs):
    assert byte_bpe.encode_documents(no_docs, PATH, PATTERN).count() == 0
    assert length_histogram.length_histogram(no_docs.select(F.lit(1).alias("n_tokens"))).count() == 0


def test_histogram_against_plain_sums(spark):
    lengths = [0, 0, 1, 5, 5, 5, 300, 300, 70000, None]
    hist = length_histogram.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    lengths = [x or 0 for x in lengths]
    rows = {r.n_tokens: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 3, 5, 299, 10 ** 6]
    got = {r.context_limit: (r.docs_cut, r.truncated_total) for r in length_histogram.at_limits(hist, limits).collect()}
    assert got == {n: (sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in limits}
    assert length_histogram.length_quantile(hist, 0.5) == 5


def test_histogram_query(spark, sf_small, small_docs, exact):
    lengths = [len(exact.encode_ordinary(r.text)) for r in small_docs.collect()]
    rows = Q.op7_length_histogram(spark, sf_small).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in set(lengths)}
    assert {r.n_tokens: r.truncated_total for r in rows} == {n: sum(min(x, n) for x in lengths) for n in set(lengths)}

"""Feistel sharding (3): a permutation, equal counts, gapless slots, layout does not matter."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesight.llm import queries as Q
from tablesight.llm import shuffle_shards as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 17, 100, 1000])
def test_permutation(n):
    assert sorted(S.permute(i, n, 5) for i in range(n)) == list(range(n))


def test_walk_bound_holds():
    for n in range(1, 3000):
        a, b = S.grid(n)
        assert a * b >= n and a * b - n < a <= n ** 0.5 + 2


def check_laws(rows, n):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(counts.values()) - min(counts.values(), default=0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in rows} <= {"rows"} and {r["grown_shard"] for r in rows} <= {None}


def test_query_against_brute_force(spark, sf_small, small_docs):
    rows = [r.asDict() for r in Q.op3_feistel_shards(spark, sf_small).collect()]
    check_laws(rows, small_docs.count())
    order = sorted(small_docs.collect(), key=lambda r: r.doc_id)
    for number, r in enumerate(order):
        got = next(x for x in rows if x["doc_id"] == r.doc_id)
        raw = r.text.encode()
        assert (got["size"], got["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (got["shard"], got["slot"]) == S.place(number, len(order), 8, 20240229)


def test_layout_does_not_matter(spark, small_docs):
    key = ["doc_id", "shard", "slot"]
    a = S.document_shards(small_docs.repartition(1)).select(*key).collect()
    b = S.document_shards(small_docs.repartition(13)).select(*key).collect()
    assert sorted(a) == sorted(b)


def test_edge_rows(edge_docs, no_docs):
    rows = [r.asDict() for r in S.document_shards(edge_docs).collect()]
    check_laws(rows, edge_docs.count())
    empty = [r for r in rows if r["size"] == 1]
    assert len(empty) == 3 and {r["text_crc32"] for r in empty} == {0}
    assert S.document_shards(no_docs).count() == 0
    clash = edge_docs.drop("text").withColumn("Shard", F.lit("x")).withColumn("__at", F.lit(1))
    out = S.assign_shards(clash, ["doc_id"], 3)
    assert out.filter("shard not in (0, 1, 2)").count() == 0 and out.count() == edge_docs.count()


def test_hot_key(spark):
    rows = [r.asDict() for r in S.assign_shards(spark.range(5000).select(F.lit(7).alias("doc_id")), ["doc_id"]).collect()]
    check_laws(rows, 5000)

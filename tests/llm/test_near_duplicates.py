"""SimHash near-duplicates (8) against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablesight.llm import components as C
from tablesight.llm import queries as Q
from tablesight.llm import simhash_pivots as S


def plain_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in
             "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in (text or "")).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    """Least index of each one's class, by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    forest = S.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 3).tolist():
            forest.join(i, i + 1 + j)
    return [forest.find(i) for i in range(len(fps))]


def check(docs, rows):
    table = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda r: r[:2])
    fps = [plain_fingerprint(t) for _, _, t in table]
    classes = plain_classes(fps)
    least = [None if table[c][0] else table[c][1] for c in classes]
    want = sorted((str(None if null else i), f"{f:016x}", str(c)) for (null, i, _), f, c in zip(table, fps, least))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_query_against_all_pairs(spark, sf_small, small_docs):
    check(small_docs, Q.op8_simhash_pivots(spark, sf_small).collect())


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs, S.near_duplicates(edge_docs).collect())
    assert S.near_duplicates(no_docs).count() == 0
    assert S.one_per_class(no_docs).count() == 0


def test_one_of_each_class_stays(edge_docs):
    kept = S.one_per_class(edge_docs.withColumn("__row", F.lit("clash")).withColumn("fp", F.lit(0)))
    assert {(r["__row"], r.fp) for r in kept.collect()} == {("clash", 0)}
    ids = sorted(str(r.doc_id) for r in kept.collect())
    want = {str(r.component_id) for r in S.near_duplicates(edge_docs).collect()}
    assert ids == sorted(want) and kept.columns[-2:] == ["__row", "fp"]


@pytest.mark.parametrize("limit", [20, 2048])
def test_dense_ball_of_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "GROUP", limit)
    rng = np.random.default_rng(limit)
    fps = {12345678901234567}
    for i in range(1500):
        x = 12345678901234567
        for b in rng.choice(64 if i % 2 else 12, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 62, 500)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {}
    for r in S.classes(df).collect():
        got.setdefault(r.root, set()).add(r.fp % (1 << 64))
    want = {}
    for x, c in zip(fps, plain_classes(fps)):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_triples_leave_no_link_out():
    masks = S.triple_masks()
    assert len(masks) == 20
    rng = np.random.default_rng(0)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        mask = next(m for m in masks if not m & flips)
        assert any(not m & flips for m in S.finer_masks(mask))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 500 for i in range(500, 560)}}

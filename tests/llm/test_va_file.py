"""Clustering by a VA-file (12): against exact distances in plain Python, bounds, edge rows."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tablesight.llm import queries as Q
from tablesight.llm import va_file as V

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, dims=64, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in hashed[:clusters]]

    def distance(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), t in zip(kept, to) if t == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    far = [distance(v, centroids[t]) for (_, v), t in zip(kept, to)]
    return sorted(((i is not None, i or 0), t, d, sum(x for x, y in zip(far, to) if y == t), sum(far),
                   hashlib.sha256(",".join(map(str, centroids[t])).encode()).hexdigest())
                  for (i, _), t, d in zip(kept, to, far))


def same(result, expected):
    rows = [tuple(r) for r in result.select(*COLUMNS).collect()]
    assert sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in rows) == expected


def test_query_against_brute_force(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    same(Q.op12_va_file_clusters(spark, sf_small), brute(rows))


def test_edge_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    rows += [(0, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (None, [0.5] * 64), (400, None), (401, []),
             (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [float("nan")] + [1.0] * 63),
             (406, [float("inf")] + [1.0] * 63), (407, [3000.0] * 64), (408, [-0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    extra = df.withColumns({"cluster": F.lit("x"), "__cells": F.lit(1), "__vector": F.lit(2), "Distance": F.lit(3)})
    expected = brute(rows)
    same(V.cluster_vectors(df.repartition(5)), expected)
    same(V.cluster_vectors(extra, bits=1), expected)
    same(V.cluster_vectors(df, bits=8), expected)


def test_few_equal_and_huge_vectors(spark):
    few = [(i, [0.25] * 64) for i in range(5)]
    df = spark.createDataFrame(few, "vec_id int, embedding array<float>")
    same(V.cluster_vectors(df), brute(few))
    assert V.cluster_vectors(df.limit(0)).count() == 0
    assert V.cluster_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    huge = df.withColumn("embedding", F.when(F.col("vec_id") < 2, F.array_repeat(F.lit(3e38).cast("float"), 64))
                         .otherwise(F.col("embedding")))
    out = V.cluster_vectors(huge, clusters=1).collect()
    assert len(out) == 5 and all(r["distance"] >= 0 for r in out)


def test_intervals_hold_and_save_distances():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-40, 40, (500, 8))
    centroids = rng.integers(-40, 40, (6, 8))
    for bits in (1, 3, 7):
        cells = 1 << bits
        marks = np.sort(rng.integers(-40, 40, (8, cells + 1)), axis=1)
        marks[:, 0], marks[:, -1] = vectors.min(axis=0), vectors.max(axis=0) + 1
        marks = np.sort(np.clip(marks, marks[:, :1], marks[:, -1:]), axis=1)
        numbers = V.cell_numbers(vectors, marks)
        assert (V.unpack(V.pack(numbers, bits), 8, bits) == numbers).all()
        low, high = V.interval_tables(marks, centroids)
        d = np.arange(8)
        true = (vectors[:, :, None] - centroids.T[None]) ** 2
        assert (low[d, numbers] <= true).all() and (true <= high[d, numbers]).all()
        fetched = []

        def fetch(rows):
            fetched.append(len(rows))
            return vectors[rows]

        cluster, candidates = V.nearest(numbers, fetch, (low, high), centroids)
        assert (cluster == true.sum(axis=1).argmin(axis=1)).all()
        assert sum(fetched) == (candidates > 1).sum()
        if bits == 7:
            assert sum(fetched) < len(vectors) / 4

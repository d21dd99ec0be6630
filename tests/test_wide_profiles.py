"""Blocked correlations, capped distinct sets, joins with hot keys, keywords
with hot terms, forests and joint restarts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablesight.operators import anomaly as A
from tablesight.operators import gram
from tablesight.operators import kmeans
from tablesight.operators import ml as M
from tablesight.operators import profile as P
from tablesight.operators import skew
from tablesight.operators import text as X


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _wide(spark, n_columns, rows=60):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(rows, n_columns)) * 10.0 ** rng.integers(-3, 6, n_columns) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 1], x[:, 2], x[: rows // 2, 3] = 5.1, np.nan, np.nan
    x[7, 5] = np.inf
    x[:, 4] = np.where(np.arange(rows) % 2 == 0, 0.1, np.nan)   # constant where present
    names = [f"c{i}" for i in range(n_columns)]
    return spark.createDataFrame(pd.DataFrame(x, columns=names)), names


@pytest.mark.parametrize("with_self", [False, True])
def test_blocked_correlations_equal_the_plain_ones(spark, monkeypatch, with_self):
    df, names = _wide(spark, 70)
    wide = P.correlation_pairs(df.repartition(3), names, with_self)
    assert "Generate" not in _plan(wide) and _plan(wide).count("MapInArrow") == 3
    got = {(r.col_a, r.col_b): r.corr for r in wide.collect()}
    monkeypatch.setattr(P, "WIDE_PAIRS", 10 ** 9)
    some = names[:12]
    want = {(r.col_a, r.col_b): r.corr for r in P.correlation_pairs(df, some, with_self).collect()}
    assert len(got) == 70 * 69 // 2 + 70 * with_self
    for k, w in want.items():
        g = got[k]
        assert (g is None) == (w is None), (k, g, w)
        assert w is None or (math.isnan(w) and math.isnan(g)) or abs(g - w) < 1e-9, (k, g, w)


def test_blocks_of_many_tasks_are_added(spark, monkeypatch):
    monkeypatch.setattr(gram, "SLOT_TASKS", 2)
    monkeypatch.setattr(P, "WIDE_PAIRS", 0)
    df = spark.range(1000).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(5)])
    got = {(r.col_a, r.col_b): r.corr for r in P.correlation_pairs(df.repartition(9)).collect()}
    x = np.sin(np.arange(1000)[:, None] * np.arange(1, 6))
    want = np.corrcoef(x.T)
    assert all(abs(g - want[int(a[1]), int(b[1])]) < 1e-9 for (a, b), g in got.items()) and len(got) == 10


def test_capped_distinct_sets(spark):
    df = spark.range(5000).select(
        F.col("id").alias("many"), (F.col("id") % 200).cast("string").alias("at_limit"), (F.col("id") % 201).alias("over"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("one"))
    cols = df.columns
    assert P.capped_distinct(df.repartition(6), cols, 200) == {"many": 201, "at_limit": 200, "over": 201, "none": 0, "one": 1}
    assert P.capped_distinct(df.limit(0), cols, 3) == dict.fromkeys(cols, 0)


def test_no_expand_in_inference(spark, sf_small, monkeypatch):
    """What i1, i2 and p12 run has no copy of the rows per distinct column."""
    from pyspark.sql.classic.dataframe import DataFrame
    plans = []
    first = DataFrame.first
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "first", lambda d: plans.append(_plan(d)) or first(d))
    monkeypatch.setattr(DataFrame, "collect", lambda d: plans.append(_plan(d)) or collect(d))
    for q in ("i1_infer_schema", "i2_infer_column_types", "p12_drop_high_cardinality"):
        plans.append(_plan(E.queries()[q](spark, sf_small)))
    assert len(plans) > 5 and not [p for p in plans if "Expand" in p]


def test_hot_split_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    rows = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id"))
                                   .alias("k"))
    groups = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    few = groups.filter("k % 2 = 0")
    got = skew.hot_split_join(rows, few, ["k"], "n", "left")
    tops = {r.k: r.top for r in few.collect()}
    assert sorted((r.id, r.top) for r in got.collect()) == [(r.id, tops.get(r.k)) for r in rows.orderBy("id").collect()]
    assert skew.hot_split_join(rows, few, ["k"], "n").count() == sum(r.k in tops for r in rows.collect())
    with pytest.raises(ValueError):
        skew.hot_split_join(rows, few, ["k"], "n", "outer")


@pytest.mark.parametrize("known", [0, 5, 10 ** 6])
def test_keywords_however_many_terms_are_known(spark, monkeypatch, known):
    monkeypatch.setattr(X, "KNOWN_TERMS", known)
    monkeypatch.setattr(X, "SLICE_CHARS", 200)
    df = spark.range(300).select(F.concat_ws(" ", F.lit("everywhere Everywhere"), F.concat(F.lit("w"), F.col("id") % 40),
                                             F.when(F.col("id") % 50 == 0, F.repeat(F.lit("long"), 40))).alias("text"))
    out = X.top_keywords(df.repartition(4), k=6)
    assert "Window" not in _plan(out)
    rows = [r.text.lower().split() for r in df.collect()]
    n, counts = len(rows), {}
    for words in rows:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    want = {}
    for words in rows:
        w = {t: words.count(t) * (math.log((1 + n) / (1 + counts[t])) + 1) for t in set(words)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            want[t] = want.get(t, 0) + v / norm
    best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:6]
    got = [(r.term, r.score) for r in out.collect()]
    assert [t for t, _ in got] == [t for t, _ in best] and np.allclose([v for _, v in got], [v for _, v in best])


def test_complete_trees_give_the_trees_path_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)).round(1)
    depth, trees, want = 6, [], np.zeros(300)
    for _ in range(5):
        grown = [np.array(a) for a in A._grow(x[rng.choice(300, 64)], rng, depth)]
        trees.append(A.complete_tree(*grown, depth))
        feature, split, left, right, size = grown
        for i, row in enumerate(x):
            node, level = 0, 0
            while feature[node] >= 0:
                node, level = (left if row[feature[node]] < split[node] else right)[node], level + 1
            want[i] += level + A.avg_path(float(size[node]))
    assert np.allclose(A.path_lengths(x, trees, depth), want, rtol=0, atol=1e-9)


def test_positions_in_key_order(spark):
    rows = [(i // 2, f"k{i % 2}") for i in range(40)] + [(3, "k0"), (None, "a")]
    df = spark.createDataFrame(rows, "a int, b string")
    found = [r for r in df.collect() if r.a in (0, 3, 19)][:5]
    order = sorted(rows, key=lambda r: (r[0] is not None, r))
    assert A.positions(df, ["a", "b"], found) == [order.index((r.a, r.b)) for r in found]
    assert A.positions(df, ["a", "b"], []) == []


def test_joint_restarts_reach_the_cost_of_separate_ones(spark):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, size=(150, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2], [6, 6, 0], [9, 1, 4])])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>")
    feats = M.vectors_from_array(df, "v").repartition(3)
    assigned, cost = M.cluster(feats, k=5, n_init=10)
    best = min(KMeans(k=5, seed=42 + i).fit(feats).summary.trainingCost for i in range(3))
    assert cost <= best * 1.001
    assert sorted(r["size"] for r in M.cluster_sizes(assigned).collect()) and assigned.count() == len(x)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert M.cluster(M.vectors_from_array(same, "v"), k=3, n_init=2)[1] == 0.0


def test_restarts_share_their_passes(spark, monkeypatch):
    df = spark.range(200).select(F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double")).alias("v"))
    passes = []
    sums = kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda rows, v, starts, *a, **k: passes.append(len(starts)) or sums(rows, v, starts, *a, **k))
    kmeans.fit(df, "v", 4, 10, 1)
    assert len(passes) <= kmeans.INIT_ROUNDS + 2 + kmeans.MAX_ITERATIONS and max(passes) == 10

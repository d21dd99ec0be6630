import math
import re
from collections import Counter

import numpy as np
import pytest

from tablesight.operators import anomaly as A
from tablesight.operators import ml as M
from tablesight.functions.stop_words import ENGLISH
from tablesight.operators import text as X

DOCS = [
    "The quick brown fox jumps. The fox sleeps! Foxes run fast? Yes, foxes run.",
    "Data pipelines move data. Pipelines fail. Data wins.",
    "Déjà vu: café crème, café noir. Über alles über.",
    "",
    "the the the",
]


def _brute_keywords(docs, max_features, k):
    stop = set(ENGLISH)
    toks = [[t for t in re.findall(r"\b\w\w+\b", d.lower()) if t not in stop] for d in docs if d]
    n = len(toks)
    total = Counter(t for ts in toks for t in ts)
    vocab = sorted(total, key=lambda t: (-total[t], t))[:max_features]
    df = Counter(t for ts in toks for t in set(ts) if t in vocab)
    score = Counter()
    for ts in toks:
        c = Counter(t for t in ts if t in vocab)
        w = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            score[t] += x / norm
    return sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:k]


def test_stop_words_are_spark_mls(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize("limit", [6, None])
def test_keywords_match_brute_force(spark, limit):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([*DOCS, None])], "doc_id long, text string")
    got = [(r.term, r.score) for r in X.top_keywords(df, max_features=limit, k=4).collect()]
    want = _brute_keywords(DOCS, limit, 4)
    assert [t for t, _ in got] == [t for t, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert abs(a - b) < 1e-9


def test_keywords_beyond_the_known_ones(spark, monkeypatch):
    """Rows with rarer terms, long terms and counts beyond one packed word; the terms of
    a row are written once between the passes, at four bytes each."""
    rng = np.random.default_rng(4)
    docs = [" ".join([*(f"word{i}" for i in rng.zipf(1.3, 300) % 3000), f"rare{d}", *["both"] * (d % 2)]) for d in range(400)]
    docs += ["many " * 5000 + "seldom", "x" * 70 + " word1", "x" * 70 + " many", "", "word1 word2"]
    docs += docs[:20]
    want = _brute_keywords(docs, None, 40)
    lists = []

    def kept(df, label):
        lists.extend(t for _, t in df.dtypes if t.startswith("array"))
        return scratch(df, label)

    scratch = X.scratch_table
    monkeypatch.setattr(X, "scratch_table", kept)
    for known in (2000, 1):
        monkeypatch.setattr(X, "KNOWN_TERMS", known)
        lists.clear()
        got = [(r.term, r.score) for r in X.top_keywords(
            spark.createDataFrame([(d,) for d in docs], "text string").repartition(3), k=40).collect()]
        assert [t for t, _ in got] == [t for t, _ in want]
        assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-9
        assert lists == ["array<int>"]


def test_short_documents_keep_their_text(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, "x" * 900), (3, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.summary) for r in X.extractive_summary(df, keys=["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "One. Two. Three."), (2, "x" * 900), (3, None), (3, "")], key=str)
    assert X.summarize("x" * 900, frozenset(), short_chars=800) == "x" * 800


def test_summary_keeps_original_order(spark):
    sents = [f"Sentence number {i} talks about topic{i % 3} and words{i}." for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(sents))], "doc_id long, text string")
    summary = X.extractive_summary(df, max_sentences=8).first().summary
    picked = [s for s in sents if s in summary]
    assert len(picked) == 8 and summary == " ".join(picked)


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    rows += [(10_000 + i, 40.0 + i, -40.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    res = A.anomaly(df, ["x", "y"], ["id"], contamination=0.01, n_trees=50)
    top = {r.id for r in res["top"].limit(10).collect()}
    assert len(top & set(range(10_000, 10_010))) >= 8
    s = res["summary"].first()
    assert 0 < s.anomaly_count <= 0.011 * len(rows) + 1


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, (a, b), t in zip(range(300), x, y)],
                               "id long, a double, b double, y double")
    pred = M.regress(df, "y", ["a", "b"], [], ["id"], model="ridge")
    m = M.regression_metrics(pred).first()
    assert m.r2 > 0.99 and m.n_test > 20


@pytest.mark.parametrize("k", [3])
def test_kmeans_finds_planted_clusters(spark, k):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [20, 20], [-20, 20]])
    pts = np.concatenate([c + rng.normal(size=(100, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    f = M.feature_pipeline(df, ["a", "b"], [], keep=["id"])
    assigned, _ = M.cluster(f, k=k, n_init=3)
    sizes = sorted(r["size"] for r in M.cluster_sizes(assigned).collect())
    assert sizes == [100, 100, 100]


def test_classification_metrics_binary(spark):
    pred = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)],
                                 "label double, prediction double")
    r = M.classification_metrics(pred).first()
    assert abs(r.accuracy - 0.6) < 1e-12 and abs(r.precision - 2 / 3) < 1e-12
    assert abs(r.recall - 2 / 3) < 1e-12 and r.n_test == 5


def test_classification_learns_text_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), "yes" if x > 0.3 else "no", "a" if i % 2 else "b") for i, x in enumerate(rng.normal(size=400))]
    rows += [(1000 + i, 0.0, None, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y string, c string")
    pred = M.classify(df, "y", ["x"], ["c"], ["id"], n_trees=20)
    m = M.classification_metrics(pred, df.select("y"), "random_forest").first()
    assert m.accuracy > 0.95 and m.classes == "no,yes" and m.n_train + m.n_test == 400


def test_split_is_stratified_and_repeatable(spark):
    rows = [(i, "rare" if i % 40 == 0 else "common" if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    one = {r.id: r.split for r in M.hash_split(df, ["id"], stratify="y").collect()}
    assert one == {r.id: r.split for r in M.hash_split(df.repartition(7), ["id"], stratify="y").collect()}
    for cls in ("rare", "common", None):
        ids = [i for i, y in rows if y == cls]
        assert sum(one[i] == "test" for i in ids) == round(0.2 * len(ids))


def test_features_come_from_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b")], "x double, c string")
    model = M.fit_features(train, ["x"], ["c"])
    assert model.median["x"] == 2.0 and model.mean["x"] == 2.0 and model.categories["c"] == ["a", "b"]
    other = spark.createDataFrame([(1000.0, "z"), (None, None)], "x double, c string")
    rows = [r.features.toArray().tolist() for r in model.transform(other).collect()]
    assert rows[0][1:] == [0.0, 0.0] and rows[1] == [0.0, 1.0, 0.0]


def test_rare_categories_share_a_slot(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), ("d",)], "c string")
    model = M.fit_features(df, [], ["c"], max_categories=3)
    got = {r.c: r.features.toArray().tolist() for r in model.transform(df, ["c"]).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], "d": [0, 0, 1]}


def test_forest_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    a, b = ({r.id: r.anomaly_score for r in A.isolation_forest_scores(
        df.repartition(n), ["x", "y"], ["id"], n_trees=10, max_samples=64).collect()} for n in (2, 7))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_task_functions_need_no_package_on_workers(spark):
    """Functions that run in tasks are pickled whole, not by module name."""
    import pickletools

    from pyspark import cloudpickle

    data = cloudpickle.dumps(A._grow)
    names = [arg for op, arg, _ in pickletools.genops(data) if op.name in ("SHORT_BINUNICODE", "BINUNICODE")]
    assert "_grow" in names and not any(op.name == "STACK_GLOBAL" and "tablesight" in str(arg)
                                        for op, arg, _ in pickletools.genops(data))


def test_tasks_prepare_and_report(spark):
    from tablesight.plans.tasks import Tunables, run_tasks
    rng = np.random.default_rng(0)
    rows = [(i, f"2024-01-{1 + i % 28:02d}", float(x), "u" if x > 0 else "v", 7, 1700000000 + i, f"lorem ipsum {i}. " * 5)
            for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "`Row id` long, `Order date` string, `the x` double, grp string, k int, stamp long, body string")
    res = run_tasks(df, ["Row id"], "grp", "the x", "body", knobs=Tunables(
        rf_trees=5, anomaly_trees=20, kmeans_k=2, kmeans_restarts=1, regression_model="ridge"))
    assert {r.task: r.status for r in res["status"].collect()} == {t: "ok" for t in (
        "descriptive", "anomaly", "clustering", "classification", "regression", "text")}
    text = res["plain_english"].first()[0].split("\n")
    assert len(text) == 5 and text[0] == "- The dataset has **120 rows** and **6 columns**."
    assert res["anomaly_top"].columns[:2] == ["row_index", "Row_id"]

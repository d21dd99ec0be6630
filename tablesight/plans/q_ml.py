"""Registered queries for learning operators.

Outputs of models that depend on the library's random streams are checked by
rows (and by invariants in tests); features, metrics, splits and the ridge of one
feature have SQL.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablesight.operators import anomaly as A
from tablesight.operators import ml as M
from tablesight.operators import text as X
from tablesight.plans import standins as S
from tablesight.plans.q_charts import _hash_sql
from tablesight.plans.registry import query, rounded
from tablesight.plans.tasks import Tunables, run_tasks
from tablesight.session import scratch_table

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def supervised(spark, d):
    """documents joined to their labels, with text statistics as features."""
    docs = S.table(spark, d, "documents")
    lab = S.table(spark, d, "labels")
    stats = X.text_stats(docs, "text", ["doc_id", "lang", "source", "n_chars"])
    return stats.join(lab, "doc_id")


def _top_sql(table: str, column: str, k: int) -> str:
    """(values) the k most frequent values of a column, most frequent first."""
    return (f"SELECT list(v ORDER BY n DESC, v) AS v FROM (SELECT {column} AS v, count(*) AS n FROM {table} "
            f"WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {k})")


def _hot_sql(column: str, top: str, k: int) -> str:
    """One-hot list of a column by its list of top values: k - 1 and the others."""
    slot = (f"coalesce(list_position(CASE WHEN len({top}) = {k} THEN {top}[1:{k - 1}] ELSE {top} END, coalesce({column}, {top}[1])), "
            f"CASE WHEN len({top}) = {k} THEN {k} END, 0)")
    return f"[CASE WHEN i = {slot} THEN 1.0 ELSE 0.0 END for i in range(1, len({top}) + 1)]"


def _scaled_sql(table: str, column: str) -> str:
    filled = f"coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM {table}))"
    return (f"({filled} - (SELECT avg({filled}) FROM {table})) / (SELECT CASE WHEN stddev_pop({filled}) > 0 "
            f"THEN stddev_pop({filled}) ELSE 1 END FROM {table})")


@query("m1_feature_pipeline", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END::DOUBLE AS size, p_retailprice AS price,
                  CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand, p_type AS kind FROM part),
b AS ({_top_sql('p', 'brand', 10)}), k AS ({_top_sql('p', 'kind', 10)}),
f AS (SELECT p_partkey, list_concat([{_scaled_sql('p', 'size')}, {_scaled_sql('p', 'price')}],
                                    {_hot_sql('brand', 'b.v', 10)}, {_hot_sql('kind', 'k.v', 10)}) AS features FROM p, b, k)
SELECT p_partkey, unnest(range(len(features)))::INTEGER AS slot, round(unnest(features), 9) AS value FROM f""")
def m1(spark, d):
    """Missing numbers and categories, and more categories than slots."""
    p = S.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("kind"))
    f = M.feature_pipeline(p, ["size", "price"], ["brand", "kind"], keep=["p_partkey"], max_categories=10)
    return rounded(f.select("p_partkey", F.posexplode(vector_to_array("features")).alias("slot", "value")), {"value": 9})


@query("m2_split", f"""
WITH h AS (SELECT doc_id, quality, {_hash_sql(['doc_id'])} AS h FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def m2(spark, d):
    return M.hash_split(supervised(spark, d), ["doc_id"], stratify="quality").select("doc_id", "quality", "split")


def _labelled(spark, d):
    """The labelled documents with their quality as text."""
    return supervised(spark, d).withColumn("grade", F.when(F.col("quality") == 1, "good").otherwise("poor"))


def _classify(spark, d, model, n_trees=250):
    return M.classify(_labelled(spark, d), "grade", ["n_chars", "words", "lines"], ["lang"], ["doc_id"],
                      model=model, n_trees=n_trees)


@query("m3_classify")
def m3(spark, d):
    return _classify(spark, d, "random_forest")


@query("m3_classify_logreg")
def m3b(spark, d):
    return _classify(spark, d, "logreg")


# A rule's predictions, so that the metrics can be checked without a model.
_RULE_SQL = """SELECT o_orderstatus AS label, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_orderkey % 3 = 0 THEN 'O'
  ELSE 'P' END AS prediction FROM orders"""


def _rule(spark, d):
    o = S.table(spark, d, "orders")
    p = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_orderkey") % 3 == 0, "O").otherwise("P")
    return o.select(F.col("o_orderstatus").alias("label"), p.alias("prediction"))


def _metrics_sql(rule: str, target: str, binary: bool) -> str:
    """The metrics' formulas: the last class of two, or all weighted by support."""
    pick = "(SELECT %s FROM s WHERE c = (SELECT max(label) FROM t))" if binary else "(SELECT sum(%s * support) / sum(support) FROM s)"
    return f"""
WITH p AS ({rule}), t AS ({target}), c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS predicted,
             (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM c),
q AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS re FROM k),
s AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f FROM q),
m AS (SELECT (SELECT count(*) FROM p WHERE label = prediction) / (SELECT count(*) FROM p) AS accuracy,
             {pick % 'pr'} AS precision, {pick % 're'} AS recall, {pick % 'f'} AS f1)
SELECT round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST((SELECT count(*) FROM t) - (SELECT count(*) FROM p) AS BIGINT) AS n_train,
       CAST((SELECT count(*) FROM p) AS BIGINT) AS n_test, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM t)) AS classes,
       'rule' AS model, printf('The classifier achieved accuracy=%.3f and F1=%.3f. Accuracy is overall correctness, while F1 balances false alarms vs missed detections.', accuracy, f1) AS plain_english
FROM m"""


_M4_ROUND = {"accuracy": 9, "precision": 9, "recall": 9, "f1": 9}


@query("m4_classification_metrics", _metrics_sql(_RULE_SQL, "SELECT o_orderstatus AS label FROM orders", False))
def m4(spark, d):
    rule = _rule(spark, d)
    return rounded(M.classification_metrics(rule, rule.select("label"), "rule"), _M4_ROUND)


_TWO_SQL = """SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS label,
  CASE WHEN l_discount > 0.07 THEN 'yes' ELSE 'no' END AS prediction FROM lineitem"""


@query("m4_classification_metrics_two_classes", _metrics_sql(_TWO_SQL, f"SELECT label FROM ({_TWO_SQL})", True))
def m4b(spark, d):
    li = S.table(spark, d, "lineitem")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    both = li.select(yes(F.col("l_returnflag") == "R").alias("label"), yes(F.col("l_discount") > 0.07).alias("prediction"))
    return rounded(M.classification_metrics(both, both.select("label"), "rule"), _M4_ROUND)


@query("m4_classification_metrics_forest")
def m4c(spark, d):
    docs = _labelled(spark, d)
    return M.classification_metrics(_classify(spark, d, "random_forest", 50), docs.select("grade"), "random_forest")


@query("m5_confusion_matrix", f"SELECT label, prediction, count(*) AS count FROM ({_RULE_SQL}) p GROUP BY 1, 2")
def m5(spark, d):
    return M.confusion_matrix(_rule(spark, d))


def _regress(spark, d, model):
    p = S.table(spark, d, "part")
    return M.regress(p, "p_retailprice", ["p_size"], ["p_brand", "p_type"], ["p_partkey"], model=model)


@query("m6_regress_ridge")
def m6(spark, d):
    return _regress(spark, d, "ridge")


_RIDGE_X = "CASE WHEN p_partkey % 13 <> 0 THEN p_size END::DOUBLE"


@query("m6_regress_ridge_one_feature", f"""
WITH h AS (SELECT p_partkey, {_RIDGE_X} AS x, p_retailprice AS y, {_hash_sql(['p_partkey'])} AS h FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS r, count(*) OVER () AS n FROM h),
t AS (SELECT * FROM r WHERE r > round(n * 0.2)),
m AS (SELECT quantile_cont(x, 0.5) AS med FROM t),
s AS (SELECT avg(coalesce(x, med)) AS mean, CASE WHEN stddev_pop(coalesce(x, med)) > 0 THEN stddev_pop(coalesce(x, med)) ELSE 1 END AS sd FROM t, m),
z AS (SELECT r.*, (coalesce(x, med) - mean) / sd AS z, r.r <= round(r.n * 0.2) AS test FROM r, m, s),
w AS (SELECT avg(y) AS ybar, sum((y - (SELECT avg(y) FROM z WHERE NOT test)) * z) / (sum(z * z) + 1.0) AS b FROM z WHERE NOT test)
SELECT p_partkey, y AS label, round(ybar + b * z, 6) AS prediction FROM z, w WHERE test""")
def m6c(spark, d):
    """Ridge on one standardised feature with gaps: slope = S_zy / (S_zz + alpha)."""
    p = S.table(spark, d, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")).alias("x"))
    return rounded(M.regress(p, "p_retailprice", ["x"], [], ["p_partkey"], model="ridge"), {"prediction": 6})


@query("m6_regress_forest")
def m6b(spark, d):
    return _regress(spark, d, "random_forest")


@query("m7_regression_metrics", """
WITH p AS (SELECT p_retailprice AS y, 903.21 + p_size * 9.73 AS yhat FROM part),
m AS (SELECT avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse,
             1 - sum((y - yhat) ** 2) / (SELECT sum((y - (SELECT avg(y) FROM p)) ** 2) FROM p) AS r2, count(*) AS n_test FROM p)
SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, n_test,
       (SELECT count(*) FROM part) - n_test AS n_train, 'rule' AS model,
       printf('The regression model has MAE=%.3f and RMSE=%.3f (lower is better). R²=%.3f measures how much variance is explained (closer to 1 is better).', mae, rmse, r2) AS plain_english
FROM m""")
def m7(spark, d):
    """The metrics of a price rule, so that they can be checked without a model."""
    p = S.table(spark, d, "part")
    pred = p.select(F.col("p_retailprice").alias("label"), (F.lit(903.21) + F.col("p_size") * 9.73).alias("prediction"))
    return rounded(M.regression_metrics(pred, p.agg(F.count("p_retailprice")), "rule"), {"mae": 6, "rmse": 6, "r2": 6})


@query("m7_regression_metrics_ridge")
def m7b(spark, d):
    return M.regression_metrics(_regress(spark, d, "ridge"), S.table(spark, d, "part").agg(F.count("p_retailprice")), "ridge")


@query("c10_actual_vs_predicted")
def c10(spark, d):
    return _regress(spark, d, "ridge").select("label", "prediction")


def _embeddings(spark, d):
    return scratch_table(M.vectors_from_array(S.table(spark, d, "embeddings"), "embedding"), "embeddings")


@query("m8_cluster")
def m8(spark, d):
    assigned, _ = M.cluster(_embeddings(spark, d), k=5, n_init=10)
    return M.cluster_sizes(assigned)


@query("m8_cluster_table")
def m8b(spark, d):
    """k-means on the M1 features of the customer table."""
    c = S.table(spark, d, "customer")
    f = M.feature_pipeline(c, ["c_acctbal", "c_nationkey"], ["c_mktsegment"], keep=["c_custkey"])
    assigned, _ = M.cluster(f, k=5, n_init=10)
    return M.cluster_sizes(assigned)


@query("m9_pca_project")
def m9(spark, d):
    return M.pca_project(_embeddings(spark, d), 2, keep=["vec_id"])


def _anomaly(spark, d):
    li = S.table(spark, d, "lineitem")
    return A.anomaly(li, LI_NUM, LI_KEY)


@query("m10_anomaly")
def m10(spark, d):
    return _anomaly(spark, d)["summary"]


@query("t2_top_anomalies")
def t2(spark, d):
    return _anomaly(spark, d)["top"]


@query("m13_task_gating", """
WITH sup AS (SELECT quality FROM documents JOIN labels USING (doc_id))
SELECT 'descriptive' AS task, 'ok' AS status, NULL AS reason
UNION ALL SELECT 'clustering', 'skipped', 'Need feature columns and at least k rows'
UNION ALL SELECT 'classification', CASE WHEN count(DISTINCT quality) >= 2 THEN 'ok' ELSE 'skipped' END,
       CASE WHEN count(DISTINCT quality) < 2 THEN 'Target has <2 classes' END FROM sup
UNION ALL SELECT 'regression', 'skipped', 'Target column not found: price'
UNION ALL SELECT 'text', 'skipped', 'No text column'""")
def m13(spark, d):
    """Task status for the labelled documents: every task's precondition, with
    more clusters asked for than there are rows."""
    sup = supervised(spark, d).drop("source")
    res = run_tasks(sup, ["doc_id"], classification_target="quality", regression_target="price",
                    tasks=["descriptive", "clustering", "classification", "regression", "text"],
                    knobs=Tunables(kmeans_k=10 ** 9, classification_model="logreg"))
    return res["status"]

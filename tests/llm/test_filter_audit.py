"""Filter interaction audit (11): against sets in plain Python, edge rows, hot texts."""

import math
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tablesight.llm import filter_audit as A
from tablesight.llm import queries as Q


def failing(rows):
    """Letters each row of (doc_id, text) fails."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", body)) > 2 * len(body):
            fails.add("C")
        if re.search(r"[#$%&*|]", body):
            fails.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == body for o, t in rows):
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels):
    """(part, order, step) -> counts; rows are (doc_id, text, source)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failing([(d, t) for d, t, _ in rows])
    out = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(rows[i][0], fails[i]) for i in range(len(rows)) if (rows[i][2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone),
                    sum(r[1] == {f} for r in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def same(result, expected):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in result.collect()}
    assert got == expected


def test_query_against_brute_force(spark, sf_small, small_docs):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in small_docs.collect()]
    same(Q.op11_filter_interactions(spark, sf_small), brute(rows, [tuple(r) for r in labels.collect()]))


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    expected = brute(rows, [tuple(r) for r in labels.collect()])
    clash = edge_docs.withColumns({"row": F.lit(1), "part": F.lit("x"), "digest": F.lit(2), "Good": F.lit(True)})
    same(A.filter_interactions(edge_docs.repartition(3), labels), expected)
    same(A.filter_interactions(clash, labels.withColumn("good", F.lit("y"))), expected)
    assert A.filter_interactions(no_docs, labels).count() == 0
    none = A.filter_interactions(edge_docs, labels.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_hot_text_and_source(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(
            F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    out = A.filter_interactions(docs, labels).filter("filter_order = 'EABCD'").orderBy("step").collect()
    assert [r["removed"] for r in out] == [1999, 4001, 0, 0, 0] and out[0]["good_lost"] == 1999
    assert out[0]["shapley"] == 1999 * math.factorial(5) // 2  # before A in half of the orders


def test_other_filters(spark):
    rows = spark.createDataFrame([(i, "p", False, i == 3) for i in range(4)], "row long, part string, good boolean, toxic boolean")
    fails = {"X": spark.createDataFrame([(1,), (3,)], "row long"), "Y": spark.createDataFrame([(3,)], "row long")}
    out = {(r["filter_order"], r["step"]): r for r in A.audit(rows, fails).collect()}
    assert set(out) == {("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)}
    assert [out["XY", 2][c] for c in COLUMNS] == [2, 0, 1, 0, 0, 0, 1]
    assert [out["YX", 2][c] for c in COLUMNS] == [2, 1, 1, 1, 0, 0, 3]
    with pytest.raises(ValueError):
        A.audit(rows, {"long": fails["X"]})

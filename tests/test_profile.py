import uuid

import numpy as np
import pandas as pd
import pytest

from tablesight.operators import profile as P
from tablesight.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 301
    pdf = pd.DataFrame({
        "a": rng.normal(10, 3, n),
        "b": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(2, n)),
        "c": np.full(n, 5.0),
        "s": rng.choice(["x", "y", "z", None], n, p=[0.5, 0.3, 0.1, 0.1]),
        "allnull": [None] * n,
    })
    df = spark.createDataFrame(pdf, "a double, b double, c double, s string, allnull string")
    return df, pdf


def test_describe_matches_pandas(table):
    df, pdf = table
    got = P.describe_numeric(df, ["a", "b"]).toPandas().set_index("column")
    for c in ["a", "b"]:
        d = pdf[c].describe()
        assert got.loc[c, "count"] == d["count"]
        for k, pk in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                      ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert abs(got.loc[c, k] - d[pk]) < 1e-9, (c, k)


def _check_quantiles(spark, vals, accuracy=100):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").selectExpr("nanvl(v, null) as v")
    probs = [0.0, 0.01, 0.25, 0.5, 0.66, 0.999, 1.0]
    q = exact_quantiles(df, ["v"], probs, accuracy=accuracy)
    s = pd.Series(vals).dropna()
    for p in probs:
        assert q[("v", p)] == pytest.approx(s.quantile(p), rel=1e-9, abs=1e-12), p


def test_exact_quantiles_hot_value(spark):
    rng = np.random.default_rng(3)
    _check_quantiles(spark, np.concatenate([np.full(400, 7.0), rng.normal(size=800), [np.nan] * 10]))
    _check_quantiles(spark, np.full(50, 2.5))
    _check_quantiles(spark, rng.integers(0, 5, 900))
    _check_quantiles(spark, rng.normal(size=1000) * 1e300)


def test_quantiles_keep_infinities_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (2.0, None)], "a double, b double")
    q = exact_quantiles(df, ["a", "b"], [0.5, 1.0])
    assert q == {("a", 0.5): 2.0, ("a", 1.0): float("inf"), ("b", 0.5): None, ("b", 1.0): None}


def test_quantiles_take_a_fixed_number_of_passes(spark):
    """Five distinct values or a million: two scans of the data."""
    def jobs(df):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "quantiles")
        exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = spark.range(200_000).selectExpr("cast(id % 5 as double) v")
    many = spark.range(200_000).selectExpr("cast(id as double) v")
    assert abs(jobs(few) - jobs(many)) <= 2 and 0 < jobs(few) <= 12


def test_schema_does_not_depend_on_files_or_order(spark, tmp_path):
    from tablesight.operators.infer import infer_schema
    rows = [(i, "x" * (200 if i < 100 else 3), f"c{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "n long, s string, c string")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    df.repartition(50).orderBy("c", "n").write.parquet(f"{tmp_path}/many")
    a, b = (infer_schema(spark.read.parquet(f"{tmp_path}/{x}")).collect() for x in ("one", "many"))
    assert a == b and {r["column"]: r.kind for r in a}["s"] == "categorical"


def test_even_count_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])[("v", 0.5)] == 6.0


def test_missing_rate_counts_nan(table):
    df, pdf = table
    got = {r["column"]: r["missing_rate"] for r in P.missing_rate(df).collect()}
    assert abs(got["b"] - pdf["b"].isna().mean()) < 1e-12
    assert got["allnull"] == 1.0 and got["c"] == 0.0


def test_constant_columns(table):
    df, _ = table
    assert P.constant_columns(df) == ["c", "allnull"]


def test_duplicates_plus_distinct_equals_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")]
    df = spark.createDataFrame(rows, "x int, y string")
    assert P.duplicate_rows(df).first()[0] == 2
    assert P.duplicate_rows(df).first()[0] + df.distinct().count() == df.count()


def test_top_values_ties_and_null(table):
    df, pdf = table
    got = P.top_values(df, ["s"], k=2).toPandas()
    vc = pdf["s"].fillna("None").value_counts()
    assert list(got.sort_values("count", ascending=False)["count"]) == list(vc.values[:2])


def test_correlation_constant_is_null(table):
    df, pdf = table
    got = {(r.col_a, r.col_b): r.corr for r in P.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None
    assert abs(got[("a", "b")] - pdf["a"].corr(pdf["b"])) < 1e-9


def test_skew_matches_pandas(table):
    df, pdf = table
    got = {r["column"]: r["skew"] for r in P.skewness_table(df, ["a", "b"]).collect()}
    for c in ["a", "b"]:
        assert abs(got[c] - pdf[c].skew()) < 1e-9


def test_wide_correlation_equals_the_narrow_plan(table, monkeypatch):
    df, _ = table
    narrow = {(r.col_a, r.col_b): r.corr for r in P.correlation_pairs(df, ["a", "b", "c"], with_self=True).collect()}
    monkeypatch.setattr(P, "WIDE_PAIRS", 0)
    wide = {(r.col_a, r.col_b): r.corr for r in P.correlation_pairs(df, ["a", "b", "c"], with_self=True).collect()}
    assert narrow.keys() == wide.keys()
    for k in narrow:
        assert (narrow[k] is None) == (wide[k] is None) and abs((narrow[k] or 0) - (wide[k] or 0)) < 1e-9


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("", None), (None, "")], "x string, y string")
    assert P.duplicate_rows(df).first()[0] == 1


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, None, [1]), (1, "a", [2]), (None, "b", [2])], "x int, y string, z array<int>")
    got = {r["column"]: (r["distinct"], r["distinct_with_null"]) for r in P.distinct_counts(df).collect()}
    assert got == {"x": (1, 2), "y": (2, 3), "z": (2, 2)}

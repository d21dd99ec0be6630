"""Plan checks (the scale layer of the test strategy) and property tests."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablesight.operators import ordered as W
from tablesight.operators import profile as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _executions(spark, run):
    """Plans of everything that ran, the last one included."""
    seen = []
    log = spark._jvm.org.apache.spark.sql  # noqa: F841
    write = W.scratch_table

    def recorded(df, label):
        seen.append((label, _plan(df)))
        return write(df, label)

    W.scratch_table = recorded
    try:
        out = run()
    finally:
        W.scratch_table = write
    return seen, _plan(out)


def test_ordered_queries_range_their_rows_once(spark, sf_small):
    for name in ["w2_cum_sum", "w6_longest_drawdown", "w9_drawdown_of_cumsum", "w10_row_position", "q8_trading_equity"]:
        writes, last = _executions(spark, lambda n=name: E.queries()[n](spark, sf_small))
        ranges = [p for label, p in writes if label == "ranged"]
        assert len(ranges) == 1 and ranges[0].count("rangepartitioning") == 1, name
        assert "rangepartitioning" not in last, name


def _scans(plan, table):
    return sum(f"{table}.parquet" in line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line)


def test_packs_read_their_table_once(spark, sf_small):
    for name, table, most in [("q7_trading_backtest", "lineitem", 1), ("g16_best_worst", "lineitem", 1),
                              ("q6_clinic_general", "orders", 1), ("q1_universal_kpis", "lineitem", 2),
                              ("c4_corr_heatmap", "lineitem", 1), ("g11_repeat_rate", "orders", 1)]:
        plan = _plan(E.queries()[name](spark, sf_small))
        assert 1 <= _scans(plan, table) <= most, (name, _scans(plan, table))
    assert "Join" not in _plan(E.queries()["g3_sum_count_by_key"](spark, sf_small))
    assert "Join" not in _plan(E.queries()["q6_clinic_general"](spark, sf_small))


def test_summaries_need_no_exchange(spark, sf_small):
    assert "Exchange" not in _plan(E.queries()["m12_extractive_summary"](spark, sf_small))


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    df = E.queries()["p16_membership_filter"](spark, sf_small)
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_keyword_vocabulary_shuffles_terms_only(spark, sf_small):
    plan = _plan(E.queries()["m11_top_keywords_vocabulary"](spark, sf_small))
    assert plan.count("Exchange hashpartitioning(term") == 1 and "hashpartitioning(row" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(1, 120), buckets=st.integers(1, 9), seed=st.integers(0, 10_000))
def test_bucketed_running_values_equal_plain(spark, n, buckets, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-5, 5, n).astype(float)
    v[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"t": rng.integers(0, 5, n), "k": np.arange(n), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.expr("nanvl(v, null)"))
    got = (W.ordered_scan(df, ["t", "k"], [W.Scan("sum", "v", "s"), W.Scan("ffill", "v", "f"),
                                           W.Scan("max", "v", "m"), W.Scan("lag", "v", "l"),
                                           W.Scan("row_number", None, "r")], n_buckets=buckets)
           .toPandas().sort_values(["t", "k"]).reset_index(drop=True))
    p = pdf.sort_values(["t", "k"]).reset_index(drop=True)
    # SQL running sum: NULL rows carry the total so far; NULL before any value
    want_s = p["v"].fillna(0).cumsum().where(p["v"].notna().cumsum() > 0)
    assert np.allclose(got["s"].astype(float), want_s, equal_nan=True)
    assert np.allclose(got["f"].astype(float), p["v"].ffill(), equal_nan=True)
    assert np.allclose(got["m"].astype(float), p["v"].cummax().ffill(), equal_nan=True)
    assert np.allclose(got["l"].astype(float), p["v"].shift(1), equal_nan=True)
    assert list(got["r"]) == list(range(1, n + 1))
    peaks = W.ordered_scan(df, ["t", "k"], [W.Scan("max_of_sum", "v", "ms"), W.Scan("peak_at", "v", "p")], n_buckets=buckets)
    got = peaks.select("t", "k", "ms", "p.value", "p.at").toPandas().sort_values(["t", "k"]).reset_index(drop=True)
    assert np.allclose(got["ms"].astype(float), want_s.cummax().ffill(), equal_nan=True)
    best, at, want_at = -np.inf, np.nan, []
    for i, x in enumerate(p["v"], 1):
        if x >= best:
            best, at = x, i
        want_at.append(at)
    assert np.allclose(got["at"].astype(float), want_at, equal_nan=True)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), min_size=1, max_size=40))
def test_duplicates_plus_distinct_is_rows(spark, rows):
    df = spark.createDataFrame(rows, "x int, y string")
    assert P.duplicate_rows(df).first()[0] + df.distinct().count() == len(rows)


def test_hot_timestamp_is_split_across_buckets(spark):
    """A third of the rows share one timestamp; the range partitioning on the
    full order key (timestamp, key) still spreads them over the buckets."""
    n = 3000
    rows = [(0 if i % 3 == 0 else i, i, float(i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "ts long, k long, v double")
    sizes = (df.repartitionByRange(8, "ts", "k").groupBy(F.spark_partition_id().alias("b"))
               .count().collect())
    assert max(r["count"] for r in sizes) < n / 3
    got = W.cum_sum(df, ["ts", "k"], "v", "c", n_buckets=8).agg(F.max("c")).first()[0]
    assert got == sum(r[2] for r in rows)


def test_equity_ties_in_time_do_not_depend_on_layout(spark):
    from tablesight.plans import packs as K
    rows = [(i // 3, float((i * 37) % 11 + 1), i) for i in range(90)] + [(30, None, 91)]
    df = spark.createDataFrame(rows, "datetime int, equity double, seq int")
    m = {"datetime": "datetime", "equity": "equity"}
    a, b = (K.trading_equity(df.repartition(n), m)["kpis"].first() for n in (1, 5))
    assert a == b
    e = [r[1] for r in rows[:-1]] + [rows[-2][1]]
    run = best = longest = 0
    for x in e:
        best = max(best, x)
        run = run + 1 if x < best else 0
        longest = max(longest, run)
    assert a.data_points == 91 and a.longest_drawdown_duration_days == longest

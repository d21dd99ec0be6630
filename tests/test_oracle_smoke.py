"""Registered queries against their DuckDB twins on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
NAMES = ["q0_flagship_monthly_billing", "g1_sum_by_week", "g6_share_of_total", "g8_status_counts",
         "g14_trade_stats", "a2_missing_rate", "a4_describe_numeric", "a5_top_values", "a10_correlation_matrix",
         "w2_cum_sum", "w6_longest_drawdown", "w7_forward_fill", "p4_impute_median", "p10_to_number",
         "c1_histogram", "x2_keep_first", "g20_text_stats", "m11_top_keywords", "q6_clinic_general",
         "q8_trading_equity", "i1_infer_schema", "m12_extractive_summary", "st1_stream_period_totals",
         "s1_read_delimited", "j2_compare_runs", "s5_read_json_scalars", "k1_write_cleaned", "k4_list_runs", "p8_parse_datetimes",
         "p9_parse_epoch", "q5_clinic_billing", "q7_trading_backtest", "q9_trading_cumulative_pnl", "m2_split",
         "m4_classification_metrics", "m11_top_keywords_vocabulary", "i2_infer_column_types", "i4_infer_dataset_type",
         "a8_distinct_counts", "c4_corr_heatmap", "t6_sample_n", "w9_drawdown_of_cumsum", "q15_clean_table"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    si = {c: i for i, c in enumerate(sdf.columns)}
    oi = {c: i for i, c in enumerate(rel.columns)}
    a = sorted((tuple(_norm(r[si[c]]) for c in cols) for r in sdf.collect()), key=repr)
    b = sorted((tuple(_norm(r[oi[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "billed" in df.columns


def test_every_query_has_a_callable():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100

"""Registered queries for profiling, quality and inference."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablesight.operators import infer as I
from tablesight.operators import profile as P
from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded

GEN = f"({S.GENERIC_SQL})"
GEN_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate", "l_source", "l_bulk_note"]
GEN_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]
GEN_CAT = ["l_returnflag", "l_linestatus", "l_source", "l_bulk_note"]
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", {i} AS pos, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM g"
             for i, c in enumerate(GEN_COLS)]
    return f"WITH g AS {GEN}, m AS (" + " UNION ALL ".join(parts) + ")"


@query("a1_shape", f"SELECT count(*) AS rows, {len(GEN_COLS)} AS cols FROM {GEN} g")
def a1(spark, d):
    return P.shape(S.generic_table(spark, d))


@query("a2_missing_rate", _missing_sql() + """
SELECT "column", round(missing_rate, 12) AS missing_rate FROM m ORDER BY missing_rate DESC, pos LIMIT 25""")
def a2(spark, d):
    return rounded(P.missing_rate(S.generic_table(spark, d), top=25), {"missing_rate": 12})


@query("a3_missing_overall", _missing_sql() + """
SELECT round(avg(missing_rate), 12) AS missing_fraction_overall FROM m""")
def a3(spark, d):
    return rounded(P.missing_overall(S.generic_table(spark, d)), {"missing_fraction_overall": 12})


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {src} x"""
             for c in cols]
    return " UNION ALL ".join(parts)


_DESC_ROUND = {"mean": 6, "std": 6, "p25": 6, "p50": 6, "p75": 6}


@query("a4_describe_numeric", _describe_sql(GEN, GEN_NUM))
def a4(spark, d):
    return rounded(P.describe_numeric(S.generic_table(spark, d)), _DESC_ROUND)


def _top_values_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM g GROUP BY 2"
             for c in GEN_CAT]
    return (f"WITH g AS {GEN}, c AS (" + " UNION ALL ".join(parts) + """)
SELECT "column", value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS FIRST) AS r FROM c)
WHERE r <= 10""")


@query("a5_top_values", _top_values_sql())
def a5(spark, d):
    return P.top_values(S.generic_table(spark, d), k=10)


@query("a6_datetime_range", f"""
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min, max(l_shipdate) AS max, count(l_shipdate) AS count
FROM {GEN} g""")
def a6(spark, d):
    return P.datetime_range(S.generic_table(spark, d))


@query("a7_duplicate_rows", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT)
       AS duplicate_rows FROM documents""")
def a7(spark, d):
    return P.duplicate_rows(S.table(spark, d, "documents").select("text", "lang"))


@query("a8_distinct_counts", f"WITH g AS {GEN} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS distinct,
       CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_with_null
       FROM g""" for c in GEN_COLS))
def a8(spark, d):
    return P.distinct_counts(S.generic_table(spark, d))


@query("a9_constant_columns", f"WITH g AS {GEN} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column" FROM g
       HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1""" for c in GEN_COLS))
def a9(spark, d):
    return P.constant_columns_df(S.generic_table(spark, d))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM g")
    return f"WITH g AS {GEN}, c AS (" + " UNION ALL ".join(parts) + ")"


@query("a10_correlation_matrix", _corr_sql() + " SELECT col_a, col_b, round(corr, 9) AS corr FROM c")
def a10(spark, d):
    return rounded(P.correlation_pairs(S.generic_table(spark, d), CORR_COLS), {"corr": 9})


@query("a11_top_correlations", _corr_sql() + """
SELECT col_a, col_b, round(abs(corr), 9) AS abs_corr FROM c WHERE corr IS NOT NULL
ORDER BY abs(corr) DESC, col_a, col_b LIMIT 5""")
def a11(spark, d):
    return rounded(P.top_correlations(S.generic_table(spark, d), 5, CORR_COLS), {"abs_corr": 9})


@query("a12_top_skewed", f"WITH g AS {GEN}, s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", skewness({c}) AS skew FROM g" for c in GEN_NUM) + """)
SELECT "column", round(skew, 9) AS skew FROM s WHERE skew IS NOT NULL AND NOT isnan(skew)
ORDER BY abs(skew) DESC, "column" LIMIT 5""")
def a12(spark, d):
    return rounded(P.top_skewed(S.generic_table(spark, d), 5), {"skew": 9})


@query("a14_quality_checks", """
WITH c AS (SELECT count(*) AS n, avg(CASE WHEN event_type = 'error' AND user_id % 50 = 0 THEN 0.0 ELSE 1.0 END) AS r FROM events),
one AS (SELECT count(*) AS n, count_if(contains(p_name || ',' || p_brand, ',')) AS k FROM part),
few AS (SELECT count(*) AS n FROM region)
SELECT 'events' AS dataset, 'mostly_null' AS code, 'note' AS "column", printf('%.3f missing', r) AS detail FROM c WHERE r > 0.95
UNION ALL SELECT 'one_column', 'possible_wrong_delimiter', 'line', printf('%d of %d rows hold a comma', k, n) FROM one
WHERE k > greatest(5, 0.05 * n)
UNION ALL SELECT 'region', 'few_rows', NULL, printf('only %d rows', n) FROM few WHERE n > 0 AND n < 10
UNION ALL SELECT 'none', 'empty_table', NULL, 'table has no rows'
UNION ALL SELECT 'twice', 'duplicate_column', 'n_name', 'column name appears more than once'""")
def a14(spark, d):
    """Five tables, each with one fault."""
    events = S.table(spark, d, "events")
    note = F.when((F.col("event_type") == "error") & (F.col("user_id") % 50 == 0), "seen")
    region, nation = S.table(spark, d, "region"), S.table(spark, d, "nation")
    line = F.concat_ws(",", "p_name", "p_brand").alias("line")
    tables = {
        "events": events.select("event_id", "value", note.alias("note")),
        "one_column": S.table(spark, d, "part").select(line),
        "region": region, "none": region.filter("r_regionkey < 0"),
        "twice": nation.select("n_name", F.col("n_name"), "n_nationkey")}
    parts = [P.quality_checks(t).select(F.lit(name).alias("dataset"), "code", "column", "detail") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a15_vitals_summary", _describe_sql(f"({S.VITALS_SQL})", ["heart_rate"]))
def a15(spark, d):
    return rounded(P.vitals_summary(S.vitals(spark, d)), _DESC_ROUND)


@query("c9_missing_bars", _missing_sql() + """
SELECT "column", round(missing_rate, 12) AS missing_rate FROM m WHERE missing_rate > 0
ORDER BY missing_rate DESC, "column" LIMIT 30""")
def c9(spark, d):
    return rounded(P.missing_bars(S.generic_table(spark, d), 30), {"missing_rate": 12})


# --------------------------------------------------------------------------
# inference
# --------------------------------------------------------------------------

def _infer_sql() -> str:
    """The I1 rules in SQL, per column of the generic table."""
    rows = []
    for i, c in enumerate(GEN_COLS):
        name_id = bool(I.ID_NAME_RE.search(c))
        name_ts = bool(I.TS_NAME_RE.search(c))
        is_num = c in GEN_NUM
        is_str = c in GEN_CAT
        parse = (f"count(try_strptime(CAST({c} AS VARCHAR), '%Y-%m-%d'))" if name_ts else "0")
        minmax = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if is_num else ("NULL", "NULL")
        length = f"avg(length({c}))" if is_str else "NULL"
        rows.append(f"""SELECT {i} AS pos, '{c}' AS "column", {str(name_id).upper()} AS name_id,
  {str(name_ts).upper()} AS name_ts, {str(is_num).upper()} AS is_num, {str(is_str).upper()} AS is_str,
  count(*) AS rows, count({c}) AS nn, count(DISTINCT {c}) AS nu,
  coalesce(bool_and(lower(CAST({c} AS VARCHAR)) IN ('0','1','true','false')), FALSE) AS isbool,
  {length} AS avg_len, {parse} AS parsed, {minmax[0]} AS lo, {minmax[1]} AS hi FROM g""")
    return (f"WITH g AS {GEN}, st AS (" + " UNION ALL ".join(rows) + """)
SELECT st."column", CASE
  WHEN name_id OR (nn > 0 AND nu > 0.9 * greatest(1, nn)) THEN 'id'
  WHEN nn > 0 AND isbool THEN 'boolean'
  WHEN name_ts AND parsed > 0 THEN 'datetime'
  WHEN is_num AND lo > 1e9 AND hi < 1e11 THEN 'datetime'
  WHEN is_num AND lo > 1e12 AND hi < 1e15 THEN 'datetime'
  WHEN is_num AND lo > 1e15 AND hi < 1e18 THEN 'datetime'
  WHEN is_num AND lo > 1e18 THEN 'datetime'
  WHEN is_num AND nu > 0 AND nu < 0.05 * greatest(1, rows) AND nu < 50 THEN 'categorical'
  WHEN is_num THEN 'numeric'
  WHEN is_str AND (coalesce(avg_len, 0) > 50 OR nu > 0.7 * greatest(1, nn)) THEN 'text'
  ELSE 'categorical' END AS kind,
  CASE
  WHEN name_id OR (nn > 0 AND nu > 0.9 * greatest(1, nn)) OR (nn > 0 AND isbool) OR (name_ts AND parsed > 0) THEN NULL
  WHEN is_num AND lo > 1e9 AND hi < 1e11 THEN 'unix_seconds'
  WHEN is_num AND lo > 1e12 AND hi < 1e15 THEN 'unix_milliseconds'
  WHEN is_num AND lo > 1e15 AND hi < 1e18 THEN 'unix_microseconds'
  WHEN is_num AND lo > 1e18 THEN 'unix_nanoseconds' END AS unit_tag
FROM st """)


@query("i1_infer_schema", _infer_sql())
def i1(spark, d):
    return I.infer_schema(S.generic_table(spark, d))


def _types_sql(src: str, columns: dict[str, str]) -> str:
    """The I2 rules over columns named here with how they are stored: number,
    text, date or flag."""
    parts = []
    for c, stored in columns.items():
        one = f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS nn, count(DISTINCT {c}) AS nu,
  coalesce(bool_and(lower(CAST({c} AS VARCHAR)) IN ('0','1','true','false','0.0','1.0')), FALSE) AS isbool,
  avg(length(CAST({c} AS VARCHAR))) AS len, {f'CAST(min({c}) AS DOUBLE)' if stored == 'number' else 'NULL'} AS lo,
  {f'CAST(max({c}) AS DOUBLE)' if stored == 'number' else 'NULL'} AS hi,
  '{stored}' AS stored, {str(bool(re.search('(^|_)(id|uid)($|_)', c))).upper()} AS named_id,
  {str(bool(re.search('(^|_)(ts|time|date|created_at)($|_)', c))).upper()} AS named_time FROM s"""
        parts.append(one)
    return f"WITH s AS ({src}), st AS (" + " UNION ALL ".join(parts) + """),
k AS (SELECT *, CASE WHEN named_id THEN 'id' WHEN nn > 0 AND isbool THEN 'boolean'
  WHEN named_time AND nn > 0 THEN 'datetime'
  WHEN stored = 'number' AND lo > 1e9 AND hi < 1e11 THEN 'seconds'
  WHEN stored = 'number' AND lo > 1e12 AND hi < 1e15 THEN 'milliseconds'
  WHEN stored = 'number' AND nu > 0 AND nu < 0.05 * greatest(1, rows) AND nu < 50 THEN 'categorical'
  WHEN stored = 'number' THEN 'numeric'
  WHEN stored = 'text' AND (len > 50 OR nu > 0.7 * greatest(1, nn)) THEN 'text' ELSE 'categorical' END AS k FROM st)
SELECT "column", CASE WHEN k IN ('seconds', 'milliseconds') THEN 'datetime' ELSE k END AS kind,
       CASE WHEN k IN ('seconds', 'milliseconds') THEN 'unix_' || k END AS unit_tag FROM k
UNION ALL SELECT "column", 'categorical', NULL FROM k WHERE k = 'boolean'"""


_TYPED = {"event_id": "number", "event_time": "number", "event_type": "text", "value": "number", "props": "text",
          "big": "number", "flag": "number", "note": "text", "created_at": "date", "stamp": "number"}


@query("i2_infer_column_types", _types_sql("""
SELECT event_id, event_id % 100 AS event_time, event_type, value, props, CAST(value > 50 AS DOUBLE) AS flag,
       event_id + 1000000000000000000 AS big, repeat(props, 9) AS note, ts AS created_at,
       1700000000 + event_id AS stamp FROM events""", _TYPED))
def i2(spark, d):
    """The task engine's variant: no uniqueness rule for ids, booleans listed as
    categorical too, time names on numbers, no microsecond scale."""
    e = S.table(spark, d, "events")
    g = e.select("event_id", (F.col("event_id") % 100).alias("event_time"), "event_type", "value", "props",
                 (F.col("value") > 50).cast("double").alias("flag"),
                 (F.col("event_id") + F.lit(10 ** 18)).alias("big"), F.repeat("props", 9).alias("note"),
                 F.col("ts").alias("created_at"), (F.col("event_id") + 1700000000).alias("stamp"))
    return I.infer_schema(g, unique_id_rule=False, bool_as_categorical=True, wide_time_names=True, fine_epoch=False)


_STANDINS = {"visits": S.visits, "lab_results": S.lab_results, "vitals": S.vitals, "trade_log": S.trade_log,
             "equity_curve": S.equity_curve, "backtest_monthly": S.backtest_monthly, "order_log": S.order_log,
             "ohlcv": S.ohlcv, "billing": S.billing, "generic_table": S.generic_table}


@query("i4_infer_dataset_type", f"""
WITH n AS (SELECT (SELECT count(*) FROM ({S.TRADES_SQL})) AS trades, (SELECT count(*) FROM ({S.EQUITY_SQL})) AS days,
                  (SELECT count(*) FROM ({S.ORDERS_SQL})) AS orders, (SELECT count(*) FROM ({S.OHLCV_SQL})) AS bars)
SELECT 'visits' AS dataset, 'appointments_or_visits_table' AS dataset_type
UNION ALL SELECT 'lab_results', 'lab_results_table' UNION ALL SELECT 'vitals', 'vitals_table'
UNION ALL SELECT 'trade_log', CASE WHEN trades > 10 THEN 'trade_log' ELSE 'billing_or_revenue_table' END FROM n
UNION ALL SELECT 'equity_curve', CASE WHEN days > 50 THEN 'equity_curve' ELSE 'generic_table' END FROM n
UNION ALL SELECT 'backtest_monthly', 'backtest_monthly_summary'
UNION ALL SELECT 'order_log', CASE WHEN orders > 10 THEN 'order_log' ELSE 'generic_table' END FROM n
UNION ALL SELECT 'ohlcv', CASE WHEN bars > 10 THEN 'ohlcv_candles' ELSE 'generic_table' END FROM n
UNION ALL SELECT 'billing', 'billing_or_revenue_table' UNION ALL SELECT 'generic_table', 'generic_table'""")
def i4(spark, d):
    rows = [(name, I.infer_dataset_type(fn(spark, d))) for name, fn in _STANDINS.items()]
    return spark.createDataFrame(rows, "dataset string, dataset_type string")

"""Registered queries for the remaining inventory items: class inventory
(G21), scalar functions (F13, F18, F19, F21, F22) and the pack registry (U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.functions.scalars import currency, drawdown_label, literal_replace, strip_left
from tablesight.plans import packs as K
from tablesight.plans import standins as S
from tablesight.plans.q_packs import _CONST_SQL
from tablesight.plans.q_profile import GEN_COLS, _missing_sql
from tablesight.plans.registry import query, rounded


@query("g21_class_inventory", """
SELECT DISTINCT CAST(quality AS VARCHAR) AS class FROM documents JOIN labels USING (doc_id)""")
def g21(spark, d):
    """Sorted distinct target values of the labelled documents."""
    sup = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    return sup.select(F.col("quality").cast("string").alias("class")).distinct().orderBy("class")


@query("f18_drawdown_labels", f"""
SELECT month, round(max_drawdown, 12) AS max_drawdown,
       CASE WHEN max_drawdown < -0.20 THEN 'severe' WHEN max_drawdown < -0.10 THEN 'significant'
            ELSE 'moderate' END AS severity
FROM ({S.BACKTEST_SQL}) b""")
def f18(spark, d):
    b = S.backtest_monthly(spark, d)
    return rounded(b.select("month", "max_drawdown", drawdown_label("max_drawdown").alias("severity")),
                   {"max_drawdown": 12})


@query("f19_currency_format", f"""
SELECT doctor, format('{{:,.2f}}', sum(paid_amount)) AS revenue_text FROM ({S.VISITS_SQL}) v GROUP BY doctor""")
def f19(spark, d):
    v = S.visits(spark, d)
    return v.groupBy("doctor").agg(F.sum("paid_amount").alias("r")).select(
        "doctor", currency("r").alias("revenue_text"))


@query("f3_replace_and_strip", """
SELECT p_partkey, replace(p_type, ' ', '_') AS type_key, ltrim(p_brand, 'Brand#') AS brand_number FROM part""")
def f3(spark, d):
    return S.table(spark, d, "part").select(
        "p_partkey", literal_replace("p_type", " ", "_").alias("type_key"),
        strip_left("p_brand", "Brand#").alias("brand_number"))


@query("f22_json_and_dates", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text,
       lower(trim(event_type)) AS kind, CAST(user_id AS VARCHAR) AS user_text
FROM events""")
def f22(spark, d):
    """JSON parse (F22), ISO date text (F13), lower/trim (F1), cast to text
    (F21) on the events table."""
    e = S.table(spark, d, "events")
    return e.select("event_id",
                    F.from_json("props", "k long")["k"].alias("k"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_text"),
                    F.lower(F.trim("event_type")).alias("kind"),
                    F.col("user_id").cast("string").alias("user_text"))


@query("u1_pack_registry", _missing_sql() + f"""
, k AS (SELECT count(*) AS rows, {len(GEN_COLS)} AS cols,
          (SELECT round(avg(missing_rate), 12) FROM m) AS missing_fraction_overall,
          CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS BIGINT) AS duplicate_rows,
          8 AS numeric_columns, 4 AS categorical_columns, 1 AS datetime_columns,
          CAST((SELECT count(*) FROM ({_CONST_SQL})) AS INTEGER) AS constant_columns FROM g)
SELECT *, printf('Dataset: %d rows × %d cols. %d constant columns dropped. %d numeric columns.',
                 rows, cols, constant_columns, numeric_columns) AS summary FROM k""")
def u1(spark, d):
    """An unknown mode falls back to the universal pack."""
    k = K.run_pack(S.generic_table(spark, d), "no_such_mode")["kpis"]
    return rounded(k, {"missing_fraction_overall": 12})

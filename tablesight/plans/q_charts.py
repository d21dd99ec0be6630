"""Registered queries for chart data, sorts, samples and set operations
(C1-C11, T1-T6, X1-X3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.operators import charts as C
from tablesight.operators import topk as T
from tablesight.plans import standins as S
from tablesight.plans.q_profile import CORR_COLS, GEN
from tablesight.plans.registry import query, rounded

RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("c1_histogram", """
WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
b AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
c AS (SELECT least(CAST(floor((v - lo) * 40 / (hi - lo)) AS INTEGER) + 1, 40) AS bin, count(*) AS count
      FROM v CROSS JOIN b GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 41))
SELECT g.bin, round(lo + (hi - lo) / 40 * (g.bin - 1), 6) AS bin_lo, round(lo + (hi - lo) / 40 * g.bin, 6) AS bin_hi,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def c1(spark, d):
    return rounded(C.histogram(S.table(spark, d, "lineitem"), "l_extendedprice", 40),
                   {"bin_lo": 6, "bin_hi": 6})


@query("c2_time_line", f"""
SELECT datetime AS x, paid_amount AS y FROM ({S.VISITS_SQL}) v
WHERE datetime IS NOT NULL AND paid_amount IS NOT NULL""")
def c2(spark, d):
    return C.time_line(S.visits(spark, d), "datetime", "paid_amount")


@query("c3_bar_top20", f"""
SELECT symbol AS key, round(sum(coalesce(realized_pnl, 0.0)), 4) AS y
FROM ({S.TRADES_SQL}) t WHERE symbol IS NOT NULL GROUP BY 1
ORDER BY sum(coalesce(realized_pnl, 0.0)) DESC, key LIMIT 20""")
def c3(spark, d):
    return rounded(C.bar_top(S.trade_log(spark, d), "symbol", "realized_pnl", 20), {"y": 4})


def _heat_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                             f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS corr FROM g")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM g")
    return (f"WITH g AS {GEN}, c AS (" + " UNION ALL ".join(parts)
            + ") SELECT col_a, col_b, round(corr, 9) AS corr FROM c")


@query("c4_corr_heatmap", _heat_sql())
def c4(spark, d):
    return rounded(C.corr_heatmap(S.generic_table(spark, d), CORR_COLS), {"corr": 9})


def _hash_sql(key: list[str], seed: int = 42) -> str:
    """The sample hash of ``topk.key_hash``."""
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in key)
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 8))::BIGINT"


_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c5_scatter_points", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND {_hash_sql(_LI_KEY)} < {int(0.1 * 2 ** 32)}""")
def c5(spark, d):
    li = S.table(spark, d, "lineitem")
    return C.scatter_points(li, "l_quantity", "l_extendedprice", fraction=0.1,
                            key=_LI_KEY)


@query("c6_equity_points", f"""
SELECT row_number() OVER (ORDER BY datetime) - 1 AS index, round(equity, 4) AS y
FROM ({S.EQUITY_SQL}) e WHERE equity IS NOT NULL""")
def c6(spark, d):
    return rounded(C.equity_points(S.equity_curve(spark, d), ["datetime"], "equity"), {"y": 4})


@query("c7_drawdown_points", f"""
SELECT datetime, round(cum_value, 2) AS cum_value, round(cum_peak, 2) AS cum_peak,
       round(cum_value - cum_peak, 2) + 0.0 AS cum_drawdown
FROM (SELECT *, max(cum_value) OVER (ORDER BY datetime {RUN}) AS cum_peak
      FROM (SELECT datetime, sum(coalesce(equity, 0.0)) OVER (ORDER BY datetime {RUN}) AS cum_value
            FROM ({S.EQUITY_SQL}) e))""")
def c7(spark, d):
    out = C.drawdown_points(S.equity_curve(spark, d), ["datetime"], "equity")
    return rounded(out.select("datetime", "cum_value", "cum_peak", "cum_drawdown"),
                   {"cum_value": 2, "cum_peak": 2, "cum_drawdown": 2})


@query("c8_candles", f"""
SELECT datetime, open, high, low, close, close >= open AS up, least(open, close) AS body_bottom,
       round(abs(close - open), 9) AS body_height
FROM ({S.OHLCV_SQL}) o""")
def c8(spark, d):
    return rounded(C.candles(S.ohlcv(spark, d), k=None), {"body_height": 9})


_SERIES = {"realized_pnl": 4, "end_equity": 4, "max_drawdown": 12, "trades": 0, "agent_train_steps": 0, "avg_epsilon": 12}


def _series_sql(fill: str) -> str:
    cols = ", ".join(f"CAST(round(coalesce({c}, {fill}), {n}) AS DOUBLE) AS {c}" for c, n in _SERIES.items())
    # months with few trades lose their values, so that the fill shows
    gaps = ", ".join(f"CASE WHEN blocked_total % 3 <> 0 THEN {c} END AS {c}" for c in _SERIES)
    return f"SELECT CAST(month AS VARCHAR) AS month, {cols} FROM (SELECT month, {gaps} FROM ({S.BACKTEST_SQL}) b)"


def _gaps(spark, d):
    b = S.backtest_monthly(spark, d)
    return b.select("month", *[F.when(F.col("blocked_total") % 3 != 0, F.col(c)).alias(c) for c in _SERIES])


@query("c11_monthly_series", _series_sql("0"))
def c11(spark, d):
    return rounded(C.monthly_series(_gaps(spark, d), "month", list(_SERIES)), _SERIES)


@query("c11_monthly_table", _series_sql("NULL"))
def c11b(spark, d):
    return rounded(C.monthly_series(_gaps(spark, d), "month", list(_SERIES), fill=None), _SERIES)


@query("t1_top_k", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20""")
def t1(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return T.top_k(p, "p_retailprice", 20, ["p_partkey"])


@query("t3_head_ascending", """
SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 200""")
def t3(spark, d):
    days = (S.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))
    return T.top_k(days, "day", 200, [], ascending=True)


@query("t4_sort_by_time", f"""
SELECT datetime, l_orderkey, l_linenumber, l_partkey, symbol, round(realized_pnl, 6) AS realized_pnl
FROM ({S.TRADES_SQL}) t ORDER BY datetime, l_orderkey, l_linenumber, l_partkey, symbol""")
def t4(spark, d):
    """The order itself is checked by w10_row_position and in the tests."""
    t = S.trade_log(spark, d).select(*S.TRADE_ORDER, "realized_pnl")
    return rounded(T.sort_by_time(t, S.TRADE_ORDER), {"realized_pnl": 6})


@query("t5_hash_sample", f"SELECT * FROM orders WHERE {_hash_sql(['o_orderkey'])} < {int(0.1 * 2 ** 32)}")
def t5(spark, d):
    return T.hash_sample(S.table(spark, d, "orders"), 0.1, ["o_orderkey"])


@query("t6_sample_n", f"""
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {_hash_sql(['o_orderkey'])}, o_orderkey LIMIT 100""")
def t6(spark, d):
    return T.sample_n(S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 100, ["o_orderkey"])


@query("x1_union_all", """
SELECT doc_id AS id, text, 'documents' AS origin FROM documents
UNION ALL SELECT item_id AS id, text, 'benchmark' AS origin FROM benchmark
UNION ALL SELECT conv_id * 1000 + turn AS id, text, 'conversations' AS origin FROM conversations""")
def x1(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text",
                                                 F.lit("documents").alias("origin"))
    bench = S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text",
                                                  F.lit("benchmark").alias("origin"))
    conv = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                                     "text", F.lit("conversations").alias("origin"))
    return T.union_all(docs, bench, conv)


@query("x2_keep_first", """
SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
FROM documents GROUP BY text""")
def x2(spark, d):
    docs = S.table(spark, d, "documents").select("text", "doc_id", "lang", "source")
    return T.keep_first(docs, ["text"], ["doc_id"])


@query("x3_dedupe_rows", "SELECT DISTINCT text, lang FROM documents")
def x3(spark, d):
    return T.dedupe_rows(S.table(spark, d, "documents").select("text", "lang"))

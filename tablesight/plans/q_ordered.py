"""Registered queries for ordered-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.operators import ordered as W
from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded

EQ = f"({S.EQUITY_SQL})"
TR = f"({S.TRADES_SQL})"
TORD = "datetime, l_orderkey, l_linenumber, l_partkey, symbol"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("w1_drawdown", f"""
SELECT datetime, round(equity, 4) AS equity, round(peak, 4) AS peak, round(equity - peak, 4) + 0.0 AS drawdown
FROM (SELECT *, max(equity) OVER (ORDER BY datetime {RUN}) AS peak FROM {EQ} e)""")
def w1(spark, d):
    out = W.drawdown(S.equity_curve(spark, d), ["datetime"], "equity")
    return rounded(out, {"equity": 4, "peak": 4, "drawdown": 4})


@query("w2_cum_sum", f"""
SELECT l_orderkey, l_linenumber, l_partkey, symbol, datetime,
       round(sum(coalesce(realized_pnl, 0.0)) OVER (ORDER BY {TORD} {RUN}), 4) AS cum_pnl
FROM {TR} t""")
def w2(spark, d):
    t = S.trade_log(spark, d)
    out = W.cum_sum(t, S.TRADE_ORDER, "realized_pnl", "cum_pnl")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "symbol", "datetime", "cum_pnl"),
                   {"cum_pnl": 4})


_RET_SQL = f"""
SELECT datetime, equity / lag(equity) OVER (ORDER BY datetime) - 1 AS ret FROM {EQ} e"""


@query("w3_returns", f"""
SELECT datetime, round(ret, 12) AS ret FROM ({_RET_SQL}) r WHERE ret IS NOT NULL""")
def w3(spark, d):
    out = W.returns(S.equity_curve(spark, d), ["datetime"], "equity", "ret")
    return rounded(out.filter(F.col("ret").isNotNull()).select("datetime", "ret"), {"ret": 12})


@query("w4_volatility", f"""
SELECT count(ret) AS n_returns,
       round(CASE WHEN count(ret) > 1 THEN stddev_samp(ret) * 100 END, 9) AS daily_return_volatility,
       round(CASE WHEN count(ret) > 1 THEN stddev_samp(ret) * sqrt(252.0) * 100 END, 9) AS annualized_volatility,
       round(CASE WHEN count(ret) > 30 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) END, 9)
         AS sharpe_ratio_proxy
FROM ({_RET_SQL}) r WHERE ret IS NOT NULL""")
def w4(spark, d):
    r = W.returns(S.equity_curve(spark, d), ["datetime"], "equity", "ret")
    return rounded(W.volatility(r, "ret"), {"daily_return_volatility": 9,
                                            "annualized_volatility": 9, "sharpe_ratio_proxy": 9})


@query("w6_longest_drawdown", f"""
WITH p AS (SELECT datetime, CASE WHEN equity < max(equity) OVER (ORDER BY datetime {RUN}) THEN 1 ELSE 0 END AS below
           FROM {EQ} e),
     i AS (SELECT below, sum(1 - below) OVER (ORDER BY datetime {RUN}) AS island FROM p)
SELECT CAST(coalesce(max(run), 0) AS BIGINT) AS longest_drawdown_rows
FROM (SELECT island, sum(below) AS run FROM i GROUP BY island)""")
def w6(spark, d):
    return W.longest_drawdown(S.equity_curve(spark, d), ["datetime"], "equity")


@query("w7_forward_fill", f"""
SELECT event_id, coalesce(last_value(hr IGNORE NULLS) OVER (ORDER BY datetime, event_id {RUN}), 0.0) AS heart_rate
FROM (SELECT event_id, ts AS datetime, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS hr FROM events)""")
def w7(spark, d):
    # vitals with gaps: readings of 'error' events are missing
    v = S.table(spark, d, "events").select(
        "event_id", F.col("ts").alias("datetime"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("hr"))
    out = W.forward_fill(v, ["datetime", "event_id"], "hr", "heart_rate", fill_rest=0.0)
    return out.select("event_id", "heart_rate")


@query("w8_start_end", f"""
SELECT round(arg_min(equity, datetime), 4) AS start_value, round(arg_max(equity, datetime), 4) AS end_value,
       round(arg_max(equity, datetime) - arg_min(equity, datetime), 4) AS change,
       round(CASE WHEN arg_min(equity, datetime) <> 0
             THEN (arg_max(equity, datetime) - arg_min(equity, datetime)) / abs(arg_min(equity, datetime)) * 100 END, 9)
         AS change_pct
FROM {EQ} e""")
def w8(spark, d):
    out = W.start_end(S.equity_curve(spark, d), ["datetime"], "equity")
    return rounded(out, {"start_value": 4, "end_value": 4, "change": 4, "change_pct": 9})


@query("w9_drawdown_of_cumsum", f"""
SELECT l_orderkey, l_linenumber, l_partkey, symbol, datetime, round(cum_value, 4) AS cum_value,
       round(cum_peak, 4) AS cum_peak, round(cum_value - cum_peak, 4) + 0.0 AS cum_drawdown
FROM (SELECT *, max(cum_value) OVER (ORDER BY {TORD} {RUN}) AS cum_peak
      FROM (SELECT *, sum(coalesce(realized_pnl, 0.0)) OVER (ORDER BY {TORD} {RUN}) AS cum_value FROM {TR} t))""")
def w9(spark, d):
    out = W.drawdown_of_cumsum(S.trade_log(spark, d), S.TRADE_ORDER, "realized_pnl")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "symbol", "datetime",
                              "cum_value", "cum_peak", "cum_drawdown"),
                   {"cum_value": 4, "cum_peak": 4, "cum_drawdown": 4})


@query("w10_row_position", f"""
SELECT l_orderkey, l_linenumber, l_partkey, symbol, datetime,
       row_number() OVER (ORDER BY {TORD}) - 1 AS row_pos FROM {TR} t""")
def w10(spark, d):
    out = W.row_position(S.trade_log(spark, d), S.TRADE_ORDER, "row_pos")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "symbol", "datetime", "row_pos")

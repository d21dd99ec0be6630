"""Registered queries for grouped and business aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.operators import grouped as G
from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded

V = f"({S.VISITS_SQL})"
T = f"({S.TRADES_SQL})"
L = f"({S.LAB_SQL})"
O = f"({S.ORDERS_SQL})"
B = f"({S.BACKTEST_SQL})"


def _period_sql(unit: str) -> str:
    return f"""
SELECT CAST(date_trunc('{unit}', datetime) AS DATE) AS period, round(sum(coalesce(paid_amount, 0.0)), 2) AS amount
FROM {V} v WHERE datetime IS NOT NULL GROUP BY 1"""


@query("g1_sum_by_day", _period_sql("day"))
def g1_day(spark, d):
    return rounded(G.sum_by_period(S.visits(spark, d), "datetime", "paid_amount", "day"), {"amount": 2})


@query("g1_sum_by_week", _period_sql("week"))
def g1_week(spark, d):
    return rounded(G.sum_by_period(S.visits(spark, d), "datetime", "paid_amount", "week"), {"amount": 2})


@query("g1_sum_by_month", _period_sql("month"))
def g1_month(spark, d):
    return rounded(G.sum_by_period(S.visits(spark, d), "datetime", "paid_amount", "month"), {"amount": 2})


@query("g2_count_by_day", f"""
SELECT CAST(datetime AS DATE) AS day, count(*) AS visits FROM {V} v
WHERE datetime IS NOT NULL GROUP BY 1""")
def g2(spark, d):
    return G.count_by_day(S.visits(spark, d), "datetime")


@query("g3_sum_count_by_key", f"""
SELECT doctor AS key, round(sum(coalesce(paid_amount, 0.0)), 2) AS revenue, count(*) AS visits
FROM {V} v WHERE doctor IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, key LIMIT 50""")
def g3(spark, d):
    return rounded(G.sum_count_by_key(S.visits(spark, d), "doctor", "paid_amount", 50), {"revenue": 2})


@query("g4_top_keys_by_sum", f"""
SELECT symbol AS key, round(sum(coalesce(realized_pnl, 0.0)), 4) AS pnl
FROM {T} t WHERE symbol IS NOT NULL GROUP BY 1 ORDER BY sum(coalesce(realized_pnl, 0.0)) DESC, key LIMIT 10""")
def g4(spark, d):
    return rounded(G.top_keys_by_sum(S.trade_log(spark, d), "symbol", "realized_pnl", 10, "pnl"),
                   {"pnl": 4})


@query("g4_top_procedures_by_revenue", f"""
SELECT procedure AS key, round(sum(coalesce(paid_amount, 0.0)), 2) AS revenue
FROM {V} v WHERE procedure IS NOT NULL GROUP BY 1 ORDER BY sum(coalesce(paid_amount, 0.0)) DESC, key LIMIT 50""")
def g4b(spark, d):
    return rounded(G.top_keys_by_sum(S.visits(spark, d, True), "procedure", "paid_amount", 50, "revenue"),
                   {"revenue": 2})


@query("g5_top_keys_by_count", f"""
WITH c AS (SELECT procedure AS key, count(*) AS count FROM {V} v WHERE procedure IS NOT NULL GROUP BY 1)
SELECT key, count, round(count / (SELECT sum(count) FROM c), 12) AS share FROM c
ORDER BY count DESC, key LIMIT 50""")
def g5(spark, d):
    return rounded(G.top_keys_by_count(S.visits(spark, d, True), "procedure", 50), {"share": 12})


@query("g5_top_lab_tests", f"""
WITH c AS (SELECT test_name AS key, count(*) AS count FROM {L} l WHERE test_name IS NOT NULL GROUP BY 1)
SELECT key, count, round(count / (SELECT sum(count) FROM c), 12) AS share FROM c
ORDER BY count DESC, key LIMIT 20""")
def g5b(spark, d):
    return rounded(G.top_keys_by_count(S.lab_results(spark, d), "test_name", 20), {"share": 12})


@query("g6_share_of_total", f"""
WITH c AS (SELECT doctor AS key, count(*) AS count FROM {V} v WHERE doctor IS NOT NULL GROUP BY 1)
SELECT key, round(count / (SELECT sum(count) FROM c), 12) AS share FROM c
ORDER BY count DESC, key LIMIT 20""")
def g6(spark, d):
    return rounded(G.share_of_total(S.visits(spark, d), "doctor", 20), {"share": 12})


@query("g7_sum_by_side", f"""
SELECT CAST(side AS VARCHAR) AS side, round(sum(coalesce(realized_pnl, 0.0)), 4) AS pnl
FROM {T} t WHERE side IS NOT NULL GROUP BY 1""")
def g7(spark, d):
    return rounded(G.sum_by_side(S.trade_log(spark, d), "side", "realized_pnl"), {"pnl": 4})


_STATUS_SQL = """
CASE WHEN s IS NULL THEN 'other'
     WHEN s LIKE '%no show%' OR s LIKE '%no-show%' OR s LIKE '%noshow%' OR s LIKE '%no\\_show%' ESCAPE '\\' THEN 'no_show'
     WHEN s LIKE '%cancel%' OR s LIKE '%cxl%' THEN 'cancelled'
     WHEN s LIKE '%completed%' OR s LIKE '%done%' OR s LIKE '%attended%' THEN 'completed'
     ELSE 'other' END"""


@query("g8_status_counts", f"""
SELECT {_STATUS_SQL} AS status, count(*) AS count
FROM (SELECT trim(regexp_replace(lower(status), '[^a-z0-9_-]', ' ', 'g')) AS s FROM {V} v) x
GROUP BY 1""")
def g8(spark, d):
    return G.status_counts(S.visits(spark, d), "status")


@query("g8_status_rates", f"""
SELECT round(count_if(c = 'cancelled') / greatest(1, count(*)), 12) AS cancellation_rate,
       round(count_if(c = 'no_show') / greatest(1, count(*)), 12) AS no_show_rate
FROM (SELECT {_STATUS_SQL} AS c
      FROM (SELECT trim(regexp_replace(lower(status), '[^a-z0-9_-]', ' ', 'g')) AS s FROM {V} v) x) y""")
def g8b(spark, d):
    return rounded(G.status_rates(S.visits(spark, d), "status"),
                   {"cancellation_rate": 12, "no_show_rate": 12})


@query("g9_flag_rate", f"""
SELECT round(count_if(lower(CAST(abnormal_flag AS VARCHAR)) IN ('1','true','yes','y','abnormal'))
             / greatest(1, count(*)), 12) AS abnormal_percent FROM {L} l""")
def g9(spark, d):
    return rounded(G.flag_rate(S.lab_results(spark, d), "abnormal_flag"), {"abnormal_percent": 12})


@query("g10_order_rates", f"""
SELECT count(*) AS total_orders,
       round(count_if(regexp_matches(lower(status), 'filled|complete')) / count(*), 12) AS fill_rate,
       round(count_if(regexp_matches(lower(status), 'reject|cancel')) / count(*), 12) AS rejection_rate
FROM {O} o""")
def g10(spark, d):
    return rounded(G.order_rates(S.order_log(spark, d)), {"fill_rate": 12, "rejection_rate": 12})


@query("g11_repeat_rate", f"""
WITH c AS (SELECT patient_id, count(*) AS n FROM {V} v WHERE patient_id IS NOT NULL GROUP BY 1)
SELECT round(coalesce((SELECT sum(n) FROM c WHERE n > 1), 0) / greatest(1, (SELECT count(*) FROM {V} v2)), 12)
       AS repeat_patient_rate""")
def g11(spark, d):
    return rounded(G.repeat_rate(S.visits(spark, d), "patient_id"), {"repeat_patient_rate": 12})


@query("g12_unique_count", f"SELECT count(DISTINCT patient_id) AS unique_patients FROM {L} l")
def g12(spark, d):
    return G.unique_count(S.lab_results(spark, d), "patient_id")


@query("g13_revenue_totals", f"""
SELECT count(*) AS total_visits,
       round(sum(coalesce(paid_amount, 0.0)), 2) AS total_revenue_collected,
       round(sum(coalesce(billed_amount, 0.0)), 2) AS total_revenue_billed,
       round(sum(coalesce(billed_amount, 0.0)) - sum(coalesce(paid_amount, 0.0)), 2) AS outstanding_amount,
       round(sum(coalesce(paid_amount, 0.0)) / greatest(1, count(*)), 4) AS avg_revenue_per_visit
FROM {V} v""")
def g13(spark, d):
    return rounded(G.revenue_totals(S.visits(spark, d), "paid_amount", "billed_amount"),
                   {"total_revenue_collected": 2, "total_revenue_billed": 2,
                    "outstanding_amount": 2, "avg_revenue_per_visit": 4})


@query("g14_trade_stats", f"""
WITH p AS (SELECT coalesce(realized_pnl, 0.0) AS p FROM {T} t)
SELECT count(*) AS total_trades, round(sum(p), 4) AS total_pnl,
       round(count_if(p > 0) / greatest(1, count(*)), 12) AS win_rate,
       round(coalesce(avg(p) FILTER (WHERE p > 0), 0.0), 6) AS avg_win,
       round(coalesce(avg(p) FILTER (WHERE p <= 0), 0.0), 6) AS avg_loss,
       round(CASE WHEN abs(coalesce(sum(p) FILTER (WHERE p <= 0), 0.0)) > 0
             THEN coalesce(sum(p) FILTER (WHERE p > 0), 0.0) / abs(sum(p) FILTER (WHERE p <= 0)) END, 9)
             AS profit_factor
FROM p""")
def g14(spark, d):
    return rounded(G.trade_stats(S.trade_log(spark, d), "realized_pnl"),
                   {"total_pnl": 4, "win_rate": 12, "avg_win": 6, "avg_loss": 6, "profit_factor": 9})


@query("g15_monthly_stats", f"""
SELECT count(*) AS total_months,
       round(coalesce(sum(realized_pnl), 0.0), 4) AS total_realized_pnl,
       round(coalesce(avg(realized_pnl), 0.0), 4) AS avg_realized_pnl_per_month,
       round(coalesce(stddev_samp(realized_pnl), 0.0), 4) AS std_realized_pnl,
       CAST(sum(trades) AS BIGINT) AS total_trades, round(avg(trades), 9) AS avg_trades_per_month,
       CAST(max(trades) AS BIGINT) AS max_trades_per_month, CAST(min(trades) AS BIGINT) AS min_trades_per_month,
       round(sum(total_fees), 4) AS total_fees_paid, round(avg(total_fees), 4) AS avg_fees_per_month,
       CAST(sum(agent_train_steps) AS BIGINT) AS total_training_steps,
       round(avg(agent_train_steps), 6) AS avg_training_steps_per_month, round(avg(avg_epsilon), 12) AS avg_epsilon,
       CAST(sum(blocked_total) AS BIGINT) AS total_blocked_trades, round(avg(blocked_total), 6) AS avg_blocked_per_month,
       round(CASE WHEN sum(realized_pnl) <> 0 THEN sum(total_fees) / abs(sum(realized_pnl) + 0.001) * 100 ELSE 0.0 END, 6)
         AS fees_as_pct_of_pnl
FROM {B} b""")
def g15(spark, d):
    m = S.backtest_monthly(spark, d)
    out = G.monthly_stats(m, pnl="realized_pnl", trades="trades", fees="total_fees", steps="agent_train_steps",
                          epsilon="avg_epsilon", blocked="blocked_total")
    return rounded(out, {"total_realized_pnl": 4, "avg_realized_pnl_per_month": 4,
                         "std_realized_pnl": 4, "avg_trades_per_month": 9, "total_fees_paid": 4,
                         "avg_fees_per_month": 4, "fees_as_pct_of_pnl": 6, "avg_training_steps_per_month": 6,
                         "avg_epsilon": 12, "avg_blocked_per_month": 6})


@query("g16_best_worst", f"""
WITH b AS (SELECT month, realized_pnl AS v FROM {B} x WHERE realized_pnl IS NOT NULL)
SELECT (SELECT month FROM b ORDER BY v DESC, month LIMIT 1) AS best_label,
       round((SELECT max(v) FROM b), 4) AS best_value,
       (SELECT month FROM b ORDER BY v ASC, month LIMIT 1) AS worst_label,
       round((SELECT min(v) FROM b), 4) AS worst_value""")
def g16(spark, d):
    m = S.backtest_monthly(spark, d)
    return rounded(G.best_worst(m, "month", "realized_pnl", ["month"]),
                   {"best_value": 4, "worst_value": 4})


@query("g18_pnl_to_drawdown", f"""
SELECT round(CASE WHEN min(max_drawdown) < 0 THEN abs(sum(realized_pnl)) / abs(min(max_drawdown)) END, 2)
       AS pnl_to_max_drawdown_ratio
FROM {B} b""")
def g18(spark, d):
    out = G.monthly_stats(S.backtest_monthly(spark, d), pnl="realized_pnl", drawdown="max_drawdown")
    return rounded(out.select("pnl_to_max_drawdown_ratio"), {"pnl_to_max_drawdown_ratio": 2})


_TREND = """CASE WHEN arg_max(avg_epsilon, month) < arg_min(avg_epsilon, month) THEN 'decreasing'
            WHEN arg_max(avg_epsilon, month) > arg_min(avg_epsilon, month) THEN 'increasing' ELSE 'stable' END"""


@query("g19_first_last_trend", f"""
SELECT round(arg_min(avg_epsilon, month), 9) AS first_value, round(arg_max(avg_epsilon, month), 9) AS last_value,
       {_TREND} AS trend FROM {B} b""")
def g19(spark, d):
    m = S.backtest_monthly(spark, d)
    return rounded(G.first_last_trend(m, "avg_epsilon", ["month"]), {"first_value": 9, "last_value": 9})


@query("j1_align_grouped", f"""
WITH s AS (SELECT doctor, sum(paid_amount) AS revenue FROM {V} v WHERE status = 'completed' GROUP BY 1),
     c AS (SELECT doctor, count(*) AS visits FROM {V} v GROUP BY 1)
SELECT coalesce(s.doctor, c.doctor) AS doctor, round(coalesce(s.revenue, 0.0), 2) AS revenue,
       coalesce(c.visits, 0) AS visits
FROM s FULL OUTER JOIN c ON s.doctor = c.doctor""")
def j1(spark, d):
    v = S.visits(spark, d)
    s = v.filter(F.col("status") == "completed").groupBy("doctor").agg(F.sum("paid_amount").alias("revenue"))
    c = v.groupBy("doctor").agg(F.count(F.lit(1)).alias("visits"))
    out = (s.join(c, "doctor", "full_outer")
            .select("doctor", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("visits", F.lit(0)).alias("visits")))
    return rounded(out, {"revenue": 2})


@query("j3_broadcast_scalar", f"""
SELECT visit_id, round(paid_amount / (SELECT sum(paid_amount) FROM {V} v2), 15) AS share FROM {V} v""")
def j3(spark, d):
    v = S.visits(spark, d).select("visit_id", "paid_amount")
    return rounded(G.with_total(v, "paid_amount").select("visit_id", "share"), {"share": 15})

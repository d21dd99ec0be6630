"""Registered queries for the KPI packs (Q1-Q14) and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.plans import packs as K
from tablesight.plans import runs as R
from tablesight.plans import standins as S
from tablesight.plans.q_profile import (_DESC_ROUND, GEN, GEN_COLS, GEN_NUM, _describe_sql, _missing_sql,
                                        _top_values_sql)
from tablesight.plans.registry import query, rounded

V = f"({S.VISITS_SQL})"
EQ = f"({S.EQUITY_SQL})"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _map(df, overrides=None):
    return K.resolve_mapping(df.columns, overrides)


_CONST_SQL = " UNION ALL ".join(
    f"SELECT 1 AS c FROM g HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1"
    for c in GEN_COLS)


@query("q1_universal_kpis", _missing_sql() + f"""
, k AS (SELECT count(*) AS rows, {len(GEN_COLS)} AS cols,
          (SELECT round(avg(missing_rate), 12) FROM m) AS missing_fraction_overall,
          CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS BIGINT) AS duplicate_rows,
          8 AS numeric_columns, 4 AS categorical_columns, 1 AS datetime_columns,
          CAST((SELECT count(*) FROM ({_CONST_SQL})) AS INTEGER) AS constant_columns FROM g)
SELECT *, printf('Dataset: %d rows × %d cols. %d constant columns dropped. %d numeric columns.',
                 rows, cols, constant_columns, numeric_columns) AS summary FROM k""")
def q1(spark, d):
    k = K.universal_kpis(S.generic_table(spark, d))["kpis"]
    return rounded(k, {"missing_fraction_overall": 12})


@query("q1_universal_top_skewed", f"WITH g AS {GEN}, s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", skewness({c}) AS skew FROM g" for c in GEN_NUM) + """)
SELECT "column", round(skew, 9) AS skew FROM s WHERE skew IS NOT NULL AND NOT isnan(skew)
ORDER BY abs(skew) DESC, "column" LIMIT 5""")
def q1b(spark, d):
    return rounded(K.universal_kpis(S.generic_table(spark, d))["top_skewed"], {"skew": 9})


@query("q2_clinic_lab", f"""
SELECT count(*) AS total_tests, count(DISTINCT patient_id) AS unique_patients,
       round(count_if(lower(abnormal_flag) IN ('1','true','yes','y','abnormal')) / greatest(1, count(*)), 12)
         AS abnormal_percent, '{K.LAB_SENTENCE}' AS summary
FROM ({S.LAB_SQL}) l""")
def q2(spark, d):
    lab = S.lab_results(spark, d)
    return rounded(K.run_pack(lab, "Clinic")["kpis"], {"abnormal_percent": 12})


@query("q2_clinic_lab_top_tests", f"""
SELECT test_name AS test, count(*) AS count FROM ({S.LAB_SQL}) l WHERE test_name IS NOT NULL
GROUP BY 1 ORDER BY count DESC, test LIMIT 20""")
def q2b(spark, d):
    return K.run_pack(S.lab_results(spark, d), "clinic")["top_lab_tests"]


@query("q3_clinic_vitals", f"""
SELECT datetime, event_id, last_value(heart_rate IGNORE NULLS) OVER (ORDER BY datetime, event_id {RUN}) AS heart_rate
FROM ({S.VITALS_GAPS_SQL}) v""")
def q3(spark, d):
    v = S.vitals_gaps(spark, d)
    return K.clinic_vitals(v, _map(v), order=["datetime", "event_id"])["series"]


# A vitals table with several measures, one of them under a name that is none.
MONITOR_SQL = f"""SELECT datetime, event_id, heart_rate, heart_rate * 1.6 AS Systolic_mmHg, heart_rate AS bp_diastolic,
  97.0 AS SpO2, heart_rate AS pulse_text FROM ({S.VITALS_GAPS_SQL}) v"""


@query("q3_clinic_vitals_kpis", f"""
SELECT CAST(count(*) AS INTEGER) AS vitals_columns_detected, '{K.VITALS_SENTENCE}' AS summary
FROM (DESCRIBE {MONITOR_SQL}) c
WHERE regexp_matches(lower(column_name), 'bp|blood_pressure|systolic|diastolic|hr|heart_rate|spo2|weight')""")
def q3b(spark, d):
    v = S.vitals_gaps(spark, d)
    hr = F.col("heart_rate")
    monitor = v.select("datetime", "event_id", hr, (hr * 1.6).alias("Systolic_mmHg"), hr.alias("bp_diastolic"),
                       F.lit(97.0).alias("SpO2"), hr.alias("pulse_text"))
    return K.run_pack(monitor, "clinic")["kpis"]


@query("q3_clinic_vitals_trends", _describe_sql(f"({S.VITALS_GAPS_SQL})", ["heart_rate"]))
def q3c(spark, d):
    return rounded(K.run_pack(S.vitals_gaps(spark, d), "clinic")["vitals_trends"], _DESC_ROUND)


@query("q4_clinic_visits", f"SELECT count(*) AS total_visits, '{K.VISITS_SENTENCE}' AS summary FROM {V} v")
def q4(spark, d):
    return K.run_pack(S.visits(spark, d), "CLINIC")["kpis"]


@query("q4_clinic_visits_per_day", f"""
SELECT CAST(datetime AS DATE) AS day, count(*) AS visits FROM {V} v WHERE datetime IS NOT NULL GROUP BY 1""")
def q4b(spark, d):
    return K.run_pack(S.visits(spark, d), "clinic")["visits_per_day"]


@query("q5_clinic_billing", f"""
SELECT round(sum(coalesce(amount, 0.0)), 2) AS total_revenue_collected,
       round(sum(coalesce(amount, 0.0)), 2) AS total_revenue_billed, '{K.BILLING_SENTENCE}' AS summary
FROM ({S.BILLING_SQL}) b""")
def q5(spark, d):
    return rounded(K.run_pack(S.billing(spark, d), "clinic")["kpis"],
                   {"total_revenue_collected": 2, "total_revenue_billed": 2})


@query("q5_clinic_billing_both_amounts", f"""
SELECT round(sum(billed_amount), 2) AS total_revenue_collected, round(sum(billed_amount), 2) AS total_revenue_billed,
       '{K.BILLING_SENTENCE}' AS summary FROM {V} v""")
def q5b(spark, d):
    """Where a table has both, the inferred billing amount (the first column
    named so) comes first for either sum."""
    v = S.visits(spark, d)
    return rounded(K.clinic_billing(v, _map(v))["kpis"], {"total_revenue_collected": 2, "total_revenue_billed": 2})


@query("q5_clinic_billing_by_day", f"""
SELECT CAST(datetime AS DATE) AS period, round(sum(coalesce(amount, 0.0)), 2) AS amount
FROM ({S.BILLING_SQL}) b WHERE datetime IS NOT NULL GROUP BY 1""")
def q5c(spark, d):
    return rounded(K.run_pack(S.billing(spark, d), "clinic")["revenue_by_day"], {"amount": 2})


_STATUS = """CASE WHEN s LIKE '%no show%' OR s LIKE '%no-show%' OR s LIKE '%noshow%' OR s LIKE '%no\\_show%' ESCAPE '\\' THEN 'no_show'
     WHEN s LIKE '%cancel%' OR s LIKE '%cxl%' THEN 'cancelled'
     WHEN s LIKE '%completed%' OR s LIKE '%done%' OR s LIKE '%attended%' THEN 'completed' ELSE 'other' END"""


@query("q6_clinic_general", f"""
WITH v AS {V},
c AS (SELECT {_STATUS} AS cls FROM (SELECT trim(regexp_replace(lower(status), '[^a-z0-9_-]', ' ', 'g')) AS s FROM v)),
p AS (SELECT patient_id, count(*) AS n FROM v GROUP BY 1),
k AS (SELECT count(*) AS total_visits, sum(paid_amount) AS paid, sum(billed_amount) AS billed FROM v),
r AS (SELECT count_if(cls = 'cancelled') / greatest(1, count(*)) AS cancellation_rate,
             count_if(cls = 'no_show') / greatest(1, count(*)) AS no_show_rate FROM c),
rp AS (SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) / greatest(1, (SELECT count(*) FROM v)) AS repeat_patient_rate FROM p)
SELECT total_visits, round(paid, 2) AS total_revenue_collected, round(billed, 2) AS total_revenue_billed,
       round(billed - paid, 2) AS outstanding_amount, round(paid / greatest(1, total_visits), 4) AS avg_revenue_per_visit,
       round(cancellation_rate, 12) AS cancellation_rate, round(no_show_rate, 12) AS no_show_rate,
       round(repeat_patient_rate, 12) AS repeat_patient_rate,
       concat_ws(' ', printf('This dataset contains %d visits.', total_visits),
                 CASE WHEN paid <> 0 THEN 'Total collected revenue is ' || format('{{:,.2f}}', paid) || '.' END,
                 CASE WHEN billed - paid <> 0 THEN 'Outstanding receivables are ' || format('{{:,.2f}}', billed - paid) || '.' END,
                 printf('No-show rate is %.1f%%.', no_show_rate * 100)) AS summary
FROM k, r, rp""")
def q6(spark, d):
    v = S.visits(spark, d)
    return rounded(K.clinic_general(v, _map(v))["kpis"],
                   {"total_revenue_collected": 2, "total_revenue_billed": 2, "outstanding_amount": 2,
                    "avg_revenue_per_visit": 4, "cancellation_rate": 12, "no_show_rate": 12,
                    "repeat_patient_rate": 12})


def _general(spark, d, frame, procedure=False):
    v = S.visits(spark, d, procedure)
    return K.clinic_general(v, _map(v))[frame]


@query("q6_clinic_revenue_by_doctor", f"""
SELECT doctor AS key, round(sum(paid_amount), 2) AS revenue, count(*) AS visits FROM {V} v
GROUP BY 1 ORDER BY sum(paid_amount) DESC, key LIMIT 50""")
def q6b(spark, d):
    return rounded(_general(spark, d, "revenue_by_doctor"), {"revenue": 2})


@query("q6_clinic_status_counts", f"""
SELECT {_STATUS} AS status, count(*) AS count
FROM (SELECT trim(regexp_replace(lower(status), '[^a-z0-9_-]', ' ', 'g')) AS s FROM {V} v) GROUP BY 1""")
def q6c(spark, d):
    return _general(spark, d, "status_counts")


def _by_period(unit):
    sql = f"""SELECT CAST(date_trunc('{unit}', datetime) AS DATE) AS period, round(sum(paid_amount), 2) AS amount
FROM {V} v WHERE datetime IS NOT NULL GROUP BY 1"""

    @query(f"q6_clinic_revenue_by_{unit}", sql)
    def q6_period(spark, d):
        return rounded(_general(spark, d, f"revenue_by_{unit}"), {"amount": 2})


for _unit in ("day", "week", "month"):
    _by_period(_unit)


@query("q6_clinic_procedures_by_revenue", f"""
SELECT procedure AS key, round(sum(paid_amount), 2) AS revenue FROM {V} v WHERE procedure IS NOT NULL
GROUP BY 1 ORDER BY sum(paid_amount) DESC, key LIMIT 50""")
def q6d(spark, d):
    return rounded(_general(spark, d, "top_procedures_by_revenue", True), {"revenue": 2})


_PROCEDURES = f"""WITH c AS (SELECT procedure AS key, count(*) AS count FROM {V} v WHERE procedure IS NOT NULL GROUP BY 1)"""


@query("q6_clinic_procedures_by_count", _PROCEDURES + """
SELECT key, count, round(count / (SELECT sum(count) FROM c), 12) AS share FROM c ORDER BY count DESC, key LIMIT 50""")
def q6e(spark, d):
    return rounded(_general(spark, d, "top_procedures_by_count", True), {"share": 12})


@query("q6_clinic_procedure_mix", _PROCEDURES + """
SELECT key, round(count / (SELECT sum(count) FROM c), 12) AS share FROM c ORDER BY count DESC, key LIMIT 20""")
def q6f(spark, d):
    return rounded(_general(spark, d, "procedure_mix", True), {"share": 12})


_EPSILON = """CASE WHEN arg_max(avg_epsilon, month) < arg_min(avg_epsilon, month) THEN 'decreasing (exploration reduced)'
  WHEN arg_max(avg_epsilon, month) > arg_min(avg_epsilon, month) THEN 'increasing (exploration increased)' ELSE 'stable' END"""

_MONEY = "format('{:,.2f}', %s)"


@query("q7_trading_backtest", f"""
WITH b AS ({S.BACKTEST_SQL}),
s AS (SELECT count(*) AS total_months, coalesce(sum(realized_pnl), 0.0) AS tp, coalesce(avg(realized_pnl), 0.0) AS ap,
             coalesce(stddev_samp(realized_pnl), 0.0) AS sp, sum(trades) AS tt, avg(trades) AS at_, max(trades) AS mxt,
             min(trades) AS mnt, sum(total_fees) AS tf, avg(total_fees) AS af, min(max_drawdown) AS mdd,
             sum(agent_train_steps) AS st, avg(agent_train_steps) AS ast, avg(avg_epsilon) AS ep, {_EPSILON} AS et,
             sum(blocked_total) AS bl, avg(blocked_total) AS abl FROM b),
k AS (SELECT total_months, tp AS total_realized_pnl, ap AS avg_realized_pnl_per_month,
       sp AS std_realized_pnl, CAST(tt AS BIGINT) AS total_trades, at_ AS avg_trades_per_month,
       CAST(mxt AS BIGINT) AS max_trades_per_month, CAST(mnt AS BIGINT) AS min_trades_per_month,
       tf AS total_fees_paid, af AS avg_fees_per_month,
       CASE WHEN tp <> 0 THEN tf / abs(tp + 0.001) * 100 ELSE 0.0 END AS fees_as_pct_of_pnl,
       (SELECT month FROM b ORDER BY realized_pnl DESC, month LIMIT 1) AS best_month_realized_pnl,
       (SELECT max(realized_pnl) FROM b) AS best_month_realized_pnl_value,
       (SELECT month FROM b ORDER BY realized_pnl ASC, month LIMIT 1) AS worst_month_realized_pnl,
       (SELECT min(realized_pnl) FROM b) AS worst_month_realized_pnl_value,
       (SELECT month FROM b ORDER BY end_equity DESC, month LIMIT 1) AS best_month_end_equity,
       (SELECT max(end_equity) FROM b) AS best_month_end_equity_value,
       (SELECT month FROM b ORDER BY end_equity ASC, month LIMIT 1) AS worst_month_end_equity,
       (SELECT month FROM b ORDER BY max_drawdown ASC, month LIMIT 1) AS worst_drawdown_month,
       mdd AS worst_drawdown_pct, mdd AS max_drawdown_pct,
       CAST(st AS BIGINT) AS total_training_steps, ast AS avg_training_steps_per_month, ep AS avg_epsilon,
       et AS epsilon_trend, CAST(bl AS BIGINT) AS total_blocked_trades, abl AS avg_blocked_per_month,
       CASE WHEN mdd < 0 THEN abs(tp) / abs(mdd) END AS pnl_to_max_drawdown_ratio FROM s)
SELECT total_months, round(total_realized_pnl, 4) AS total_realized_pnl,
       round(avg_realized_pnl_per_month, 4) AS avg_realized_pnl_per_month, round(std_realized_pnl, 4) AS std_realized_pnl,
       total_trades, round(avg_trades_per_month, 9) AS avg_trades_per_month, max_trades_per_month, min_trades_per_month,
       round(total_fees_paid, 4) AS total_fees_paid, round(avg_fees_per_month, 4) AS avg_fees_per_month,
       round(fees_as_pct_of_pnl, 6) AS fees_as_pct_of_pnl, best_month_realized_pnl,
       round(best_month_realized_pnl_value, 4) AS best_month_realized_pnl_value, worst_month_realized_pnl,
       round(worst_month_realized_pnl_value, 4) AS worst_month_realized_pnl_value, best_month_end_equity,
       round(best_month_end_equity_value, 4) AS best_month_end_equity_value, worst_month_end_equity,
       worst_drawdown_month, round(worst_drawdown_pct, 12) AS worst_drawdown_pct,
       round(max_drawdown_pct, 12) AS max_drawdown_pct, total_training_steps,
       round(avg_training_steps_per_month, 6) AS avg_training_steps_per_month, round(avg_epsilon, 12) AS avg_epsilon,
       epsilon_trend, total_blocked_trades, round(avg_blocked_per_month, 6) AS avg_blocked_per_month,
       round(pnl_to_max_drawdown_ratio, 2) AS pnl_to_max_drawdown_ratio,
       concat_ws(' ', printf('This is a backtest monthly summary covering %d months.', total_months),
         'Total realized PnL: ' || {_MONEY % 'total_realized_pnl'} || '.',
         'Average monthly PnL: ' || {_MONEY % 'avg_realized_pnl_per_month'} || '.',
         'Best month: ' || best_month_realized_pnl || ' (' || {_MONEY % 'best_month_realized_pnl_value'} || ').',
         'Worst month: ' || worst_month_realized_pnl || ' (' || {_MONEY % 'worst_month_realized_pnl_value'} || ').',
         printf('Worst drawdown: %.2f%% in %s (', worst_drawdown_pct * 100, worst_drawdown_month)
           || CASE WHEN worst_drawdown_pct < -0.20 THEN 'severe' WHEN worst_drawdown_pct < -0.10 THEN 'significant'
                   ELSE 'moderate' END || ').',
         'Total fees paid: ' || {_MONEY % 'total_fees_paid'} || '.', 'Epsilon trend: ' || epsilon_trend || '.',
         CASE WHEN total_blocked_trades > 0 THEN printf('Total blocked trades: %d.', total_blocked_trades) END) AS summary
FROM k""")
def q7(spark, d):
    k = K.run_pack(S.backtest_monthly(spark, d), "trading")["kpis"]
    return rounded(k, {"total_realized_pnl": 4, "avg_realized_pnl_per_month": 4, "std_realized_pnl": 4,
                       "avg_trades_per_month": 9, "total_fees_paid": 4, "avg_fees_per_month": 4,
                       "fees_as_pct_of_pnl": 6, "best_month_realized_pnl_value": 4,
                       "worst_month_realized_pnl_value": 4, "best_month_end_equity_value": 4,
                       "worst_drawdown_pct": 12, "max_drawdown_pct": 12, "avg_training_steps_per_month": 6,
                       "avg_epsilon": 12, "avg_blocked_per_month": 6, "pnl_to_max_drawdown_ratio": 2})


@query("q7_trading_monthly_summary", f"""
SELECT month, round(realized_pnl, 4) AS realized_pnl, round(end_equity, 4) AS end_equity,
       round(max_drawdown, 12) AS max_drawdown_pct, CAST(trades AS DOUBLE) AS trades FROM ({S.BACKTEST_SQL}) b""")
def q7b(spark, d):
    t = K.run_pack(S.backtest_monthly(spark, d), "trading")["monthly_summary"]
    return rounded(t, {"realized_pnl": 4, "end_equity": 4, "max_drawdown_pct": 12})


@query("q7_trading_monthly_series", f"""
SELECT month, round(realized_pnl, 4) AS realized_pnl, round(end_equity, 4) AS end_equity,
       round(max_drawdown, 12) AS max_drawdown_pct, CAST(trades AS DOUBLE) AS trades,
       CAST(agent_train_steps AS DOUBLE) AS steps, round(avg_epsilon, 12) AS epsilon FROM ({S.BACKTEST_SQL}) b""")
def q7c(spark, d):
    t = K.run_pack(S.backtest_monthly(spark, d), "trading")["monthly_series"]
    return rounded(t, {"realized_pnl": 4, "end_equity": 4, "max_drawdown_pct": 12, "epsilon": 12})


_RET = f"SELECT datetime, equity, equity / lag(equity) OVER (ORDER BY datetime) - 1 AS ret FROM {EQ} e"


@query("q8_trading_equity", f"""
WITH e AS ({S.EQUITY_SQL}),
pk AS (SELECT *, max(equity) OVER (ORDER BY datetime {RUN}) AS peak FROM e),
b AS (SELECT *, CASE WHEN equity < peak THEN 1 ELSE 0 END AS below FROM pk),
i AS (SELECT below, sum(1 - below) OVER (ORDER BY datetime {RUN}) AS island FROM b),
ld AS (SELECT CAST(coalesce(max(run), 0) AS BIGINT) AS longest FROM (SELECT island, sum(below) AS run FROM i GROUP BY 1)),
r AS (SELECT ret FROM ({_RET}) x WHERE ret IS NOT NULL),
v AS (SELECT count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM r),
se AS (SELECT count(*) AS data_points, arg_min(equity, datetime) AS s0, arg_max(equity, datetime) AS s1,
              (SELECT min(equity - peak) FROM pk) AS mdd FROM e),
k AS (SELECT data_points, s0 AS start_equity, s1 AS end_equity, s1 - s0 AS total_return_amount,
             CASE WHEN s0 <> 0 THEN (s1 - s0) / abs(s0) * 100 END AS total_return_pct,
             mdd AS max_drawdown_amount, CASE WHEN s0 <> 0 THEN mdd / abs(s0) * 100 END AS max_drawdown_pct,
             CASE WHEN n > 1 THEN s * 100 END AS daily_return_volatility,
             CASE WHEN n > 1 THEN s * sqrt(252.0) * 100 END AS annualized_volatility,
             CASE WHEN n > 30 AND s > 0 THEN m / s * sqrt(252.0) END AS sharpe_ratio_proxy,
             longest AS longest_drawdown_duration_days FROM se, v, ld)
SELECT data_points, round(start_equity, 4) AS start_equity, round(end_equity, 4) AS end_equity,
       round(total_return_amount, 4) AS total_return_amount, round(total_return_pct, 9) AS total_return_pct,
       round(max_drawdown_amount, 4) AS max_drawdown_amount, round(max_drawdown_pct, 9) AS max_drawdown_pct,
       round(daily_return_volatility, 9) AS daily_return_volatility,
       round(annualized_volatility, 9) AS annualized_volatility, round(sharpe_ratio_proxy, 9) AS sharpe_ratio_proxy,
       longest_drawdown_duration_days,
       concat_ws(' ', printf('Equity curve analysis with %d data points.', data_points),
                 CASE WHEN total_return_pct IS NOT NULL THEN printf('Total return: %.2f%%.', total_return_pct) END,
                 CASE WHEN max_drawdown_pct IS NOT NULL THEN printf('Maximum drawdown: %.2f%%.', max_drawdown_pct) END,
                 CASE WHEN sharpe_ratio_proxy IS NOT NULL THEN printf('Sharpe ratio (proxy): %.2f.', sharpe_ratio_proxy) END)
         AS summary
FROM k""")
def q8(spark, d):
    e = S.equity_curve(spark, d)
    k = K.trading_equity(e, _map(e))["kpis"]
    return rounded(k, {"start_equity": 4, "end_equity": 4, "total_return_amount": 4, "total_return_pct": 9,
                       "max_drawdown_amount": 4, "max_drawdown_pct": 9, "daily_return_volatility": 9,
                       "annualized_volatility": 9, "sharpe_ratio_proxy": 9})


@query("q8_trading_drawdown_curve", f"""
SELECT datetime, round(equity, 4) AS equity, round(equity - max(equity) OVER (ORDER BY datetime {RUN}), 4) + 0.0 AS drawdown
FROM {EQ} e""")
def q8b(spark, d):
    e = S.equity_curve(spark, d)
    return rounded(K.trading_equity(e, _map(e))["drawdown_curve"], {"equity": 4, "drawdown": 4})


@query("q9_trading_pnl_by_symbol", f"""
SELECT symbol AS key, round(sum(realized_pnl), 4) AS pnl FROM ({S.TRADES_SQL}) t
GROUP BY 1 ORDER BY sum(realized_pnl) DESC, key LIMIT 10""")
def q9c(spark, d):
    t = S.trade_log(spark, d)
    return rounded(K.trading_trades(t, _map(t), order=S.TRADE_ORDER)["pnl_by_symbol"], {"pnl": 4})


@query("q9_trading_pnl_by_side", f"""
SELECT CAST(side AS VARCHAR) AS side, round(sum(realized_pnl), 4) AS pnl FROM ({S.TRADES_SQL}) t GROUP BY 1""")
def q9d(spark, d):
    t = S.trade_log(spark, d)
    return rounded(K.trading_trades(t, _map(t), order=S.TRADE_ORDER)["pnl_by_side"], {"pnl": 4})


@query("q9_trading_trades", f"""
WITH p AS (SELECT coalesce(realized_pnl, 0.0) AS p FROM ({S.TRADES_SQL}) t),
k AS (SELECT count(*) AS total_trades, sum(p) AS total_pnl, count_if(p > 0) / greatest(1, count(*)) AS win_rate,
             coalesce(avg(p) FILTER (WHERE p > 0), 0.0) AS avg_win, coalesce(avg(p) FILTER (WHERE p <= 0), 0.0) AS avg_loss,
             CASE WHEN abs(coalesce(sum(p) FILTER (WHERE p <= 0), 0.0)) > 0
                  THEN coalesce(sum(p) FILTER (WHERE p > 0), 0.0) / abs(sum(p) FILTER (WHERE p <= 0)) END AS profit_factor
      FROM p)
SELECT total_trades, round(total_pnl, 4) AS total_pnl, round(win_rate, 12) AS win_rate, round(avg_win, 6) AS avg_win,
       round(avg_loss, 6) AS avg_loss, round(profit_factor, 9) AS profit_factor,
       concat_ws(' ', printf('Trade log with %d trades.', total_trades),
                 'Total PnL: ' || format('{{:,.2f}}', total_pnl) || '.',
                 printf('Win rate: %.1f%%.', win_rate * 100),
                 CASE WHEN profit_factor IS NOT NULL THEN printf('Profit factor: %.2f.', profit_factor) END) AS summary
FROM k""")
def q9(spark, d):
    t = S.trade_log(spark, d)
    k = K.trading_trades(t, _map(t), order=S.TRADE_ORDER)["kpis"]
    return rounded(k, {"total_pnl": 4, "win_rate": 12, "avg_win": 6, "avg_loss": 6, "profit_factor": 9})


@query("q9_trading_cumulative_pnl", f"""
SELECT l_orderkey, l_linenumber, l_partkey, symbol,
       round(sum(coalesce(realized_pnl, 0.0)) OVER (ORDER BY datetime, l_orderkey, l_linenumber, l_partkey, symbol {RUN}), 4)
         AS cumulative_pnl
FROM ({S.TRADES_SQL}) t""")
def q9b(spark, d):
    t = S.trade_log(spark, d)
    c = K.trading_trades(t, _map(t), order=S.TRADE_ORDER)["cumulative_pnl"]
    return rounded(c.select("l_orderkey", "l_linenumber", "l_partkey", "symbol", "cumulative_pnl"),
                   {"cumulative_pnl": 4})


@query("q10_trading_orders", f"""
SELECT count(*) AS total_orders,
       round(count_if(regexp_matches(lower(status), 'filled|complete')) / count(*), 12) AS fill_rate,
       round(count_if(regexp_matches(lower(status), 'reject|cancel')) / count(*), 12) AS rejection_rate,
       printf('Order log with %d orders.', count(*)) AS summary
FROM ({S.ORDERS_SQL}) o""")
def q10(spark, d):
    o = S.order_log(spark, d)
    return rounded(K.trading(o, _map(o))["kpis"], {"fill_rate": 12, "rejection_rate": 12})


@query("q11_trading_ohlcv", f"""
SELECT count(*) AS total_bars, printf('OHLCV candle data with %d bars.', count(*)) AS summary
FROM ({S.OHLCV_SQL}) o""")
def q11(spark, d):
    o = S.ohlcv(spark, d)
    return K.trading(o, _map(o))["kpis"]


@query("q12_trading_generic", f"""
SELECT count(*) AS row_count, {len(GEN_COLS)} AS column_count,
       printf('Generic trading data: %d rows, %d columns.', count(*), {len(GEN_COLS)}) AS summary
FROM {GEN} g""")
def q12(spark, d):
    return K.trading_generic(S.generic_table(spark, d), {})["kpis"]


@query("q13_table_profile", f"""
SELECT count(*) AS rows, {len(GEN_COLS)} AS cols,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GEN} x)) AS BIGINT) AS duplicate_rows
FROM {GEN} g""")
def q13(spark, d):
    return K.table_profile(S.generic_table(spark, d))["kpis"]


@query("q13_table_profile_missing", _missing_sql() + """
SELECT "column", round(missing_rate, 12) AS missing_rate FROM m ORDER BY missing_rate DESC, pos LIMIT 20""")
def q13b(spark, d):
    return rounded(K.table_profile(S.generic_table(spark, d))["missing"], {"missing_rate": 12})


@query("q13_table_profile_describe", _describe_sql(GEN, GEN_NUM))
def q13c(spark, d):
    return rounded(K.table_profile(S.generic_table(spark, d))["describe"], _DESC_ROUND)


@query("q13_table_profile_top_values", _top_values_sql())
def q13d(spark, d):
    return K.table_profile(S.generic_table(spark, d))["top_values"]


@query("q13_table_profile_datetime_ranges", f"""
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min, max(l_shipdate) AS max, count(l_shipdate) AS count FROM {GEN} g""")
def q13e(spark, d):
    return K.table_profile(S.generic_table(spark, d))["datetime_ranges"]


@query("q14_table_describe", f"SELECT count(*) AS rows, {len(GEN_COLS)} AS cols FROM {GEN} g")
def q14k(spark, d):
    return K.table_describe(S.generic_table(spark, d))["kpis"]


@query("q14_table_describe_missing", _missing_sql() + """
SELECT "column", round(missing_rate, 12) AS missing_rate FROM m ORDER BY missing_rate DESC, pos LIMIT 25""")
def q14b(spark, d):
    return rounded(K.table_describe(S.generic_table(spark, d))["missing"], {"missing_rate": 12})


@query("q14_table_describe_numeric", _describe_sql(GEN, GEN_NUM))
def q14c(spark, d):
    return rounded(K.table_describe(S.generic_table(spark, d))["describe"], _DESC_ROUND)


_Q14_COLS = ["l_returnflag", "l_linestatus", "l_shipdate", "l_source", "l_bulk_note"]


@query("q14_table_describe_top_values", f"WITH g AS {GEN}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM g GROUP BY 2"
    for c in _Q14_COLS) + """)
SELECT "column", value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS FIRST) AS r FROM c)
WHERE r <= 10""")
def q14(spark, d):
    return K.table_describe(S.generic_table(spark, d))["top_values"]


@query("j2_compare_runs", f"""
WITH v AS {V},
c AS (SELECT {_STATUS} AS cls FROM (SELECT trim(regexp_replace(lower(status), '[^a-z0-9_-]', ' ', 'g')) AS s FROM v)),
a AS (SELECT round(sum(paid_amount), 2) AS rev, count(*) AS n FROM v),
b AS (SELECT round(sum(billed_amount), 2) AS rev, count(*) AS n FROM v),
ns AS (SELECT round(count_if(cls = 'no_show') / greatest(1, count(*)), 12) AS r FROM c)
SELECT * FROM (VALUES ('total_revenue_collected', 0), ('total_visits', 1), ('no_show_rate', 2)) m(metric, pos)
JOIN (SELECT 'total_revenue_collected' AS metric, a.rev AS run_a, b.rev AS run_b FROM a, b
      UNION ALL SELECT 'total_visits', CAST(a.n AS DOUBLE), CAST(b.n AS DOUBLE) FROM a, b
      UNION ALL SELECT 'no_show_rate', ns.r, ns.r FROM ns) x USING (metric)""")
def j2(spark, d):
    """Two clinic runs over the visits: one collects the paid amount, the
    other is mapped to the billed amount; compared side by side."""
    v = S.visits(spark, d)
    a = K.clinic_general(v, _map(v))["kpis"]
    b = K.clinic_general(v, _map(v, {"paid_amount": "billed_amount"}))["kpis"]
    ma = R.metrics_long(rounded(a, {"total_revenue_collected": 2, "no_show_rate": 12}), "run_a", "clinic")
    mb = R.metrics_long(rounded(b, {"total_revenue_collected": 2, "no_show_rate": 12}), "run_b", "clinic")
    out = R.compare_runs(ma.unionByName(mb), "run_a", "run_b", "clinic")
    return out.withColumn("pos", F.col("pos").cast("int"))


@query("j2_compare_runs_default", f"""
SELECT 'rows' AS metric, 0 AS pos, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS run_a,
       CAST((SELECT count(*) FROM customer) AS DOUBLE) AS run_b
UNION ALL SELECT 'cols', 1, 6.0, 5.0""")
def j2b(spark, d):
    """Two universal runs, compared by the default metrics."""
    runs = [R.metrics_long(K.run_pack(S.table(spark, d, t), None)["kpis"], f"run_{r}", "universal")
            for r, t in (("a", "orders"), ("b", "customer"))]
    return R.compare_runs(runs[0].unionByName(runs[1]), "run_a", "run_b", "universal")


@query("j2_compare_runs_trading", f"""
WITH p AS (SELECT realized_pnl AS p FROM ({S.TRADES_SQL}) t),
k AS (SELECT round(sum(p), 4) AS total, round(count_if(p > 0) / greatest(1, count(*)), 12) AS win FROM p)
SELECT 'total_pnl' AS metric, 0 AS pos, total AS run_a, total AS run_b FROM k
UNION ALL SELECT 'win_rate', 1, win, win FROM k UNION ALL SELECT 'max_drawdown', 2, NULL, NULL""")
def j2c(spark, d):
    """Two trading runs of one log; the pack has no drawdown, so it stays empty."""
    t = S.trade_log(spark, d)
    k = rounded(K.trading_trades(t, _map(t), order=S.TRADE_ORDER)["kpis"], {"total_pnl": 4, "win_rate": 12})
    runs = [R.metrics_long(k, r, "trading") for r in ("run_a", "run_b")]
    return R.compare_runs(runs[0].unionByName(runs[1]), "run_a", "run_b", "trading")

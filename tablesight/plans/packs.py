"""KPI packs (Q1-Q14) and the pack registry.

A pack takes a cleaned table and a role mapping and returns :class:`Frames`:
``kpis`` (one row of computed measures plus the ``summary`` sentence) and one
frame per table the pack publishes.  A pack reads column names only; a frame
that has to write rows first (ordered series, exact quantiles) does so when it
is asked for, and frames over the same ordered rows share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.frames import Frames, shared
from tablesight.functions.scalars import currency, drawdown_label, number_of, ratio_max1, yes_flag
from tablesight.operators import grouped as G
from tablesight.operators import ordered as W
from tablesight.operators import profile as P
from tablesight.operators.charts import monthly_series
from tablesight.operators.infer import infer_dataset_type, infer_roles
from tablesight.plans.registry import get_pack, register_pack
from tablesight.session import scratch_table


def resolve_mapping(columns: list[str], overrides: dict[str, str] | None = None,
                    keys: list[str] | None = None) -> dict[str, str]:
    """Canonical key -> column: user override, else the inferred role of the
    same name, else a column literally named like the key."""
    roles = infer_roles(columns)
    out = dict(roles)
    for c in columns:
        out.setdefault(c.lower(), c)
    for k, v in (overrides or {}).items():
        if v and v in columns:
            out[k] = v
    if keys is not None:
        out = {k: out[k] for k in keys if k in out}
    return out


def first_containing(columns: list[str], word: str) -> str | None:
    """The first column whose lower-cased name contains ``word``."""
    return next((c for c in columns if word in c.lower()), None)


def _sentence(*parts) -> F.Column:
    """join the non-NULL sentence parts with a space."""
    return F.concat_ws(" ", *parts)


# ---------------------------------------------------------------------------
# Q1 universal
# ---------------------------------------------------------------------------

# The sentences of the packs (F20) and the words around numbers.
UNIVERSAL_SENTENCE = "Dataset: %d rows × %d cols. %d constant columns dropped. %d numeric columns."
LAB_SENTENCE = "Lab results table with top tests and abnormal rates where available."
VITALS_SENTENCE = "Vitals table with trend lines for detected vital signs."
VISITS_SENTENCE = "Visits/appointments table: trends by day/week/month."
BILLING_SENTENCE = "Billing table: revenue totals and daily breakdowns where available."


@register_pack("universal")
def universal_kpis(df: DataFrame, mapping: dict | None = None) -> Frames:
    """Q1: shape, type counts, missing share, duplicates, constant columns,
    top correlations and skews, summary.  The table is read twice for the
    measures: one aggregate, and one pass that counts row hashes."""
    def kpis():
        k = P.overview(df).crossJoin(P.duplicate_rows(df))   # one row each
        k = k.select("rows", "cols", "missing_fraction_overall", "duplicate_rows",
                     *[F.lit(len(P.columns_of_type(df, t))).alias(f"{t}_columns") for t in ("numeric", "categorical", "datetime")],
                     "constant_columns")
        return k.withColumn("summary", F.format_string(UNIVERSAL_SENTENCE, "rows", "cols", "constant_columns", "numeric_columns"))

    out = Frames({"kpis": kpis})
    nums = P.columns_of_type(df, "numeric")
    if len(nums) >= 2:
        out["top_correlations"] = lambda: P.top_correlations(df, 5, nums)
    if nums:
        out["top_skewed"] = lambda: P.top_skewed(df, 5, nums)
    return out


# ---------------------------------------------------------------------------
# Q2-Q6 clinic
# ---------------------------------------------------------------------------

@register_pack("clinic_lab")
def clinic_lab(df: DataFrame, mapping: dict) -> Frames:
    """Q2: total tests, unique patients, abnormal share in one aggregate; top tests."""
    measures = [F.count(F.lit(1)).alias("total_tests")]
    if mapping.get("patient_id"):
        measures.append(F.countDistinct(mapping["patient_id"]).alias("unique_patients"))
    if mapping.get("abnormal_flag"):
        measures.append(ratio_max1(F.count_if(yes_flag(mapping["abnormal_flag"])), F.count(F.lit(1))).alias("abnormal_percent"))
    out = Frames({"kpis": lambda: df.agg(*measures).withColumn("summary", F.lit(LAB_SENTENCE))})
    if mapping.get("test_name"):
        out["top_lab_tests"] = lambda: G.top_keys_by_count(df, mapping["test_name"], 20).select(
            F.col("key").alias("test"), "count")
    return out


@register_pack("clinic_vitals")
def clinic_vitals(df: DataFrame, mapping: dict, order: list[str] | None = None) -> Frames:
    """Q3: vital columns found, described, and forward-filled series (leading
    gaps stay missing)."""
    cols = [c for c in df.columns if any(v in c.lower() for v in P.VITAL_KEYS)]
    order = order or ([mapping["datetime"]] if mapping.get("datetime") else None)

    def series():
        filled = [c for c in cols if c not in order]
        keyed = df.select(*dict.fromkeys(order), *[number_of(df, c).alias(c) for c in filled])
        rows = W.scan(W.ranged(keyed, W.total_order(keyed, order)), [W.Scan("ffill", c, f"__f_{c}") for c in filled])
        return rows.rows().select(*order, *[F.col(f"__f_{c}").alias(c) for c in filled])

    # one row of what the column names say; no row of the table is read for it
    out = Frames({"kpis": lambda: df.sparkSession.range(1).select(
                      F.lit(len(cols)).alias("vitals_columns_detected"), F.lit(VITALS_SENTENCE).alias("summary")),
                  "vitals_trends": lambda: P.describe_numeric(df, cols)})
    if order and cols:
        out["series"] = series
    return out


@register_pack("clinic_visits")
def clinic_visits(df: DataFrame, mapping: dict) -> Frames:
    """Q4: visits and visits per day."""
    out = Frames({"kpis": lambda: df.agg(F.count(F.lit(1)).alias("total_visits")).withColumn("summary", F.lit(VISITS_SENTENCE))})
    if mapping.get("datetime"):
        out["visits_per_day"] = lambda: G.count_by_day(df, mapping["datetime"])
    return out


@register_pack("clinic_billing")
def clinic_billing(df: DataFrame, mapping: dict) -> Frames:
    """Q5: collected and billed totals and daily revenue.  The billing amount,
    where there is one, is both what was collected and what was billed."""
    paid = mapping.get("billing_amount") or mapping.get("paid_amount") or mapping.get("paid")
    billed = mapping.get("billing_amount") or mapping.get("billed_amount") or mapping.get("billed")
    sums = {"total_revenue_collected": paid, "total_revenue_billed": billed}
    measures = [F.coalesce(F.sum(G.coerced0(df, c)), F.lit(0.0)).alias(name) for name, c in sums.items() if c]
    out = Frames({"kpis": lambda: df.agg(*(measures or [F.count(F.lit(1)).alias("total_visits")]))
                  .withColumn("summary", F.lit(BILLING_SENTENCE))})
    if mapping.get("datetime") and paid:
        out["revenue_by_day"] = lambda: G.sum_by_period(df, mapping["datetime"], paid, "day")
    return out


@register_pack("clinic_general")
def clinic_general(df: DataFrame, mapping: dict, currency_symbol: str = "") -> Frames:
    """Q6: visits, revenue, trends, doctors, procedures, status, outstanding,
    repeat patients and the summary sentence.  All single measures come from one
    pass; each published table is one more."""
    paid, billed = mapping.get("paid_amount"), mapping.get("billed_amount")
    out = Frames()
    if mapping.get("status"):
        out["status_counts"] = lambda: G.status_counts(df, mapping["status"])
    parts = [F.format_string("This dataset contains %d visits.", F.col("total_visits"))]
    if paid:
        parts.append(F.when(F.col("total_revenue_collected") != 0,
                            F.concat(F.lit("Total collected revenue is "),
                                     currency("total_revenue_collected", currency_symbol), F.lit("."))))
    elif billed:
        parts.append(F.when(F.col("total_revenue_billed") != 0,
                            F.concat(F.lit("Total billed revenue is "),
                                     currency("total_revenue_billed", currency_symbol), F.lit("."))))
    if paid and billed:
        parts.append(F.when(F.col("outstanding_amount") != 0,
                            F.concat(F.lit("Outstanding receivables are "),
                                     currency("outstanding_amount", currency_symbol), F.lit("."))))
    if mapping.get("status"):
        parts.append(F.format_string("No-show rate is %.1f%%.", F.col("no_show_rate") * 100))
    out["kpis"] = lambda: G.visit_measures(
        df, paid, billed, mapping.get("status"), mapping.get("patient_id")).withColumn("summary", _sentence(*parts))
    amt = paid or billed
    if mapping.get("datetime") and paid:
        for p in ("day", "week", "month"):
            out[f"revenue_by_{p}"] = lambda p=p: G.sum_by_period(df, mapping["datetime"], paid, p)
    if mapping.get("doctor") and amt:
        out["revenue_by_doctor"] = lambda: G.sum_count_by_key(df, mapping["doctor"], amt, 50)
    if mapping.get("procedure") and amt:
        out["top_procedures_by_revenue"] = lambda: G.top_keys_by_sum(df, mapping["procedure"], amt, 50, "revenue")
        out["top_procedures_by_count"] = lambda: G.top_keys_by_count(df, mapping["procedure"], 50)
        out["procedure_mix"] = lambda: G.share_of_total(df, mapping["procedure"], 20)
    return out


CLINIC_ROUTES = {
    "lab_results_table": clinic_lab,
    "vitals_table": clinic_vitals,
    "appointments_or_visits_table": clinic_visits,
    "billing_or_revenue_table": clinic_billing,
}


@register_pack("clinic")
def clinic(df: DataFrame, mapping: dict, dataset_type: str | None = None) -> Frames:
    """Route to the clinic pack for the detected dataset type."""
    return CLINIC_ROUTES.get(dataset_type or infer_dataset_type(df), clinic_general)(df, mapping)


# ---------------------------------------------------------------------------
# Q7-Q12 trading
# ---------------------------------------------------------------------------

def _money(c: str, symbol: str, before: str, after: str = ".") -> F.Column:
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(before), currency(c, symbol), F.lit(after)))


@register_pack("trading_backtest")
def trading_backtest(df: DataFrame, mapping: dict, currency_symbol: str = "") -> Frames:
    """Q7: every measure of the monthly table in one aggregate, the narrative,
    the monthly table (missing values kept) and the chart series (as 0)."""
    month = mapping.get("month") or first_containing(df.columns, "month")
    if month is None:
        return Frames({"kpis": lambda: df.agg(F.count(F.lit(1)).alias("total_months"))})
    used = {"pnl": "realized_pnl", "trades": "trades", "fees": "fees", "steps": "agent_train_steps",
            "epsilon": "avg_epsilon", "blocked": "blocked_total", "equity": "end_equity", "drawdown": "drawdown_pct"}
    cols = {k: mapping.get(role) for k, role in used.items()}
    # The sentences of the narrative.
    parts = [F.format_string("This is a backtest monthly summary covering %d months.", "total_months")]
    if cols["pnl"]:
        parts += [_money("total_realized_pnl", currency_symbol, "Total realized PnL: "),
                  _money("avg_realized_pnl_per_month", currency_symbol, "Average monthly PnL: ")]
        for side in ("best", "worst"):
            name = f"{side}_month_realized_pnl"
            parts.append(F.when(F.col(name).isNotNull(), F.concat(
                F.lit(f"{side.title()} month: "), F.col(name), F.lit(" ("), currency(f"{name}_value", currency_symbol), F.lit(").")))
            )
    if cols["drawdown"]:
        parts.append(F.when(F.col("worst_drawdown_pct").isNotNull(), F.concat(
            F.format_string("Worst drawdown: %.2f%% in %s (", F.col("worst_drawdown_pct") * 100, F.col("worst_drawdown_month")),
            drawdown_label("worst_drawdown_pct"), F.lit(")."))))
    if cols["fees"]:
        parts.append(_money("total_fees_paid", currency_symbol, "Total fees paid: "))
    if cols["epsilon"]:
        parts.append(F.concat(F.lit("Epsilon trend: "), F.col("epsilon_trend"), F.lit(".")))
    if cols["blocked"]:
        parts.append(F.when(F.col("total_blocked_trades") > 0,
                            F.format_string("Total blocked trades: %d.", F.col("total_blocked_trades"))))
    series = {"realized_pnl": cols["pnl"], "end_equity": cols["equity"], "max_drawdown_pct": cols["drawdown"],
              "trades": cols["trades"], "steps": cols["steps"], "epsilon": cols["epsilon"]}
    held = {name: c for name, c in series.items() if c}
    renamed = df.select(F.col(month).alias("month"), *[F.col(c).alias(name) for name, c in held.items()])
    table = [c for c in ("realized_pnl", "end_equity", "max_drawdown_pct", "trades") if c in held]
    return Frames({
        "kpis": lambda: G.monthly_stats(df, month=month, **cols).withColumn("summary", _sentence(*parts)),
        "monthly_summary": lambda: monthly_series(renamed, "month", table, fill=None),
        "monthly_series": lambda: monthly_series(renamed, "month", list(held))})


@register_pack("trading_equity")
def trading_equity(df: DataFrame, mapping: dict, order: list[str] | None = None) -> Frames:
    """Q8: return, drawdown, volatility, Sharpe proxy and longest drawdown of
    an equity curve ordered by its datetime column (other columns break ties).
    The curve is dealt out by range once; the fill, the peak, the previous value
    and the longest run all scan those rows."""
    ts, eq = mapping["datetime"], mapping["equity"]
    rest = [f.name for f in df.schema.fields if f.name not in (ts, eq) and not isinstance(f.dataType, T.MapType)]
    ties = rest if order is None else [c for c in order if c not in (ts, eq)]
    def curve_rows():
        d = df.select(F.col(ts).alias("_ts"), number_of(df, eq).alias("_v"), *ties)
        rows = W.scan(W.ranged(d, ["_ts", *ties, "_v"]), [W.Scan("ffill", "_v", "_f")])
        rows = W.Ranged(rows.frame.withColumn("_eq", F.coalesce("_f", F.lit(0.0))), rows.order)
        rows = W.scan(rows, [W.Scan("peak_at", "_eq", "_peak"), W.Scan("lag", "_eq", "_prev"), W.Scan("row_number", None, "_pos")])
        return scratch_table(rows.rows().select(
            "_ts", "_eq", "_pos", "_peak", (F.col("_eq") - F.col("_peak.value")).alias("drawdown"),
            (F.try_divide("_eq", "_prev") - 1).alias("ret")), "equity")

    curve = shared(curve_rows)
    return Frames({
        "kpis": lambda: equity_measures(curve()),
        "drawdown_curve": lambda: curve().select(F.col("_ts").alias(ts), F.col("_eq").alias(eq), "drawdown")})


def equity_measures(curve: DataFrame) -> DataFrame:
    """The measures and the sentence of Q8 over a curve's positions, peaks and
    returns, from one aggregate."""
    run = F.when(F.col("drawdown") < 0, F.col("_pos") - F.col("_peak.at"))
    r, n_ret = F.col("ret"), F.count("ret")
    one = curve.agg(
        F.count(F.lit(1)).alias("data_points"), F.min_by("_eq", "_pos").alias("start_equity"),
        F.max_by("_eq", "_pos").alias("end_equity"), F.min("drawdown").alias("max_drawdown_amount"),
        n_ret.alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
        F.coalesce(F.max(run), F.lit(0)).cast("long").alias("longest_drawdown_duration_days"))
    start, year = F.col("start_equity"), F.sqrt(F.lit(252.0))
    k = one.select(
        "data_points", "start_equity", "end_equity",
        (F.col("end_equity") - start).alias("total_return_amount"),
        F.when(start != 0, (F.col("end_equity") - start) / F.abs(start) * 100).alias("total_return_pct"),
        "max_drawdown_amount",
        F.when(start != 0, F.col("max_drawdown_amount") / F.abs(start) * 100).alias("max_drawdown_pct"),
        F.when(F.col("n") > 1, F.col("s") * 100).alias("daily_return_volatility"),
        F.when(F.col("n") > 1, F.col("s") * year * 100).alias("annualized_volatility"),
        F.when((F.col("n") > 30) & (F.col("s") > 0), F.col("m") / F.col("s") * year).alias("sharpe_ratio_proxy"),
        "longest_drawdown_duration_days")
    return k.withColumn("summary", _sentence(
        F.format_string("Equity curve analysis with %d data points.", F.col("data_points")),
        F.when(F.col("total_return_pct").isNotNull(),
               F.format_string("Total return: %.2f%%.", F.col("total_return_pct"))),
        F.when(F.col("max_drawdown_pct").isNotNull(),
               F.format_string("Maximum drawdown: %.2f%%.", F.col("max_drawdown_pct"))),
        F.when(F.col("sharpe_ratio_proxy").isNotNull(),
               F.format_string("Sharpe ratio (proxy): %.2f.", F.col("sharpe_ratio_proxy")))))


@register_pack("trading_trades")
def trading_trades(df: DataFrame, mapping: dict, order: list[str] | None = None,
                   currency_symbol: str = "") -> Frames:
    """Q9: trade statistics, PnL by symbol and side, cumulative PnL."""
    pnl = mapping.get("realized_pnl") or mapping.get("pnl")
    if not pnl:
        return Frames({"kpis": lambda: df.agg(F.count(F.lit(1)).alias("total_trades"))})
    out = Frames()
    out["kpis"] = lambda: G.trade_stats(df, pnl).withColumn("summary", _sentence(
        F.format_string("Trade log with %d trades.", F.col("total_trades")),
        F.concat(F.lit("Total PnL: "), currency("total_pnl", currency_symbol), F.lit(".")),
        F.format_string("Win rate: %.1f%%.", F.col("win_rate") * 100),
        F.when(F.col("profit_factor").isNotNull(),
               F.format_string("Profit factor: %.2f.", F.col("profit_factor")))))
    if mapping.get("symbol"):
        out["pnl_by_symbol"] = lambda: G.top_keys_by_sum(df, mapping["symbol"], pnl, 10, "pnl")
    if mapping.get("side"):
        out["pnl_by_side"] = lambda: G.sum_by_side(df, mapping["side"], pnl)
    if mapping.get("datetime"):
        out["cumulative_pnl"] = lambda: W.cum_sum(
            df, order or W.total_order(df, [mapping["datetime"]]), pnl, "cumulative_pnl")
    return out


@register_pack("trading_orders")
def trading_orders(df: DataFrame, mapping: dict) -> Frames:
    """Q10: orders, fill rate and rejection rate."""
    return Frames({"kpis": lambda: G.order_rates(df).withColumn(
        "summary", F.format_string("Order log with %d orders.", F.col("total_orders")))})


@register_pack("trading_ohlcv")
def trading_ohlcv(df: DataFrame, mapping: dict) -> Frames:
    """Q11: bar count."""
    return Frames({"kpis": lambda: df.agg(F.count(F.lit(1)).alias("total_bars")).withColumn(
        "summary", F.format_string("OHLCV candle data with %d bars.", F.col("total_bars")))})


@register_pack("trading_generic")
def trading_generic(df: DataFrame, mapping: dict) -> Frames:
    """Q12: rows and columns."""
    def kpis():
        k = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
        return k.withColumn("summary", F.format_string(
            "Generic trading data: %d rows, %d columns.", F.col("row_count"), F.col("column_count")))

    return Frames({"kpis": kpis})


_TRADING_ROUTES = {
    "backtest_monthly_summary": trading_backtest,
    "trade_log": trading_trades,
    "equity_curve": trading_equity,
    "order_log": trading_orders,
    "ohlcv_candles": trading_ohlcv,
}


@register_pack("trading")
def trading(df: DataFrame, mapping: dict, dataset_type: str | None = None) -> Frames:
    """Route to the trading pack for the detected dataset type."""
    dataset_type = dataset_type or infer_dataset_type(df)
    return _TRADING_ROUTES.get(dataset_type, trading_generic)(df, mapping)


# ---------------------------------------------------------------------------
# Q13 / Q14 profiles
# ---------------------------------------------------------------------------

def table_profile(df: DataFrame) -> Frames:
    """Q13: shape, missing (top 20), describe, top values of the string columns,
    datetime ranges, duplicate rows."""
    return Frames({"kpis": lambda: P.shape(df).crossJoin(P.duplicate_rows(df)),
                   "missing": lambda: P.missing_rate(df, top=20),
                   "describe": lambda: P.describe_numeric(df),
                   "top_values": lambda: P.top_values(df, k=10),
                   "datetime_ranges": lambda: P.datetime_range(df)})


def table_describe(df: DataFrame) -> Frames:
    """Q14: shape, missing (top 25), describe, top values of the non-numeric
    columns."""
    nonnum = [c for c in df.columns if c not in P.columns_of_type(df, "numeric")]
    return Frames({"kpis": lambda: P.shape(df),
                   "missing": lambda: P.missing_rate(df, top=25),
                   "describe": lambda: P.describe_numeric(df),
                   "top_values": lambda: P.top_values(df, nonnum, k=10)})


def run_pack(df: DataFrame, mode: str | None = None, overrides: dict | None = None) -> Frames:
    """Run the pack registered under ``mode`` (unknown -> universal)."""
    pack = get_pack(mode)
    return pack(df, resolve_mapping(df.columns, overrides))

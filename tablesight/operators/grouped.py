"""Grouped and business aggregates.

All are ``groupBy``/``agg`` plans: partial aggregation runs before the
shuffle, so a key holding a third of the rows costs one pre-aggregated row per
map task, not a third of the data in one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.functions.scalars import (number_of, parse_ts, period_start, ratio_max1, safe_ratio,
                                          status_class, trend_label, yes_flag)


def coerced0(df: DataFrame, c: str) -> Column:
    """Numeric value, bad or missing -> 0 (``to_numeric(...).fillna(0)``)."""
    return F.coalesce(number_of(df, c), F.lit(0.0))


def sum_by_period(df: DataFrame, ts: str, amount: str, period: str = "day",
                  limit: int | None = None) -> DataFrame:
    """G1: coerced amount summed per day / week (Monday) / month start;
    NULL dates dropped; ascending; the first ``limit`` periods where given."""
    dtype = df.schema[ts].dataType
    p = period_start(parse_ts(ts, dtype), period).alias("period")
    out = (df.select(p, coerced0(df, amount).alias("_a")).filter(F.col("period").isNotNull())
             .groupBy("period").agg(F.sum("_a").alias("amount")))
    out = out.orderBy("period")
    return out.limit(limit) if limit else out


def count_by_day(df: DataFrame, ts: str, limit: int | None = None) -> DataFrame:
    """Rows per calendar day, ascending; the first ``limit`` days where given."""
    d = F.to_date(parse_ts(ts, df.schema[ts].dataType)).alias("day")
    out = (df.select(d).filter(F.col("day").isNotNull())
             .groupBy("day").agg(F.count(F.lit(1)).alias("visits")).orderBy("day"))
    return out.limit(limit) if limit else out


def sum_count_by_key(df: DataFrame, key: str, amount: str, k: int | None = 50) -> DataFrame:
    """Coerced sum and row count per key in one aggregate (the
    reference aligns two grouped series with an outer join and fills 0);
    top ``k`` by sum, key as tie-breaker."""
    out = (df.groupBy(F.col(key).alias("key"))
             .agg(F.sum(coerced0(df, amount)).alias("revenue"), F.count(F.lit(1)).alias("visits"))
             .filter(F.col("key").isNotNull()))
    out = out.orderBy(F.desc("revenue"), F.asc("key"))
    return out.limit(k) if k else out


def top_keys_by_sum(df: DataFrame, key: str, amount: str, k: int = 10,
                    out: str = "total") -> DataFrame:
    """Coerced sum per key, top k (key breaks ties)."""
    return (df.filter(F.col(key).isNotNull())
              .groupBy(F.col(key).alias("key")).agg(F.sum(coerced0(df, amount)).alias(out))
              .orderBy(F.desc(out), F.asc("key")).limit(k))


def top_keys_by_count(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    """G5 + G6: row count per non-NULL key, top k, with the share of all
    non-NULL keys (NULL when there are none)."""
    counts = (df.filter(F.col(key).isNotNull())
                .groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count")))
    # total over the grouped rows: one row per key, so this window is small
    # relative to the data only when keys are few; use a scalar aggregate join.
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
                  .withColumn("share", safe_ratio(F.col("count"), F.col("_total")))
                  .drop("_total")
                  .orderBy(F.desc("count"), F.asc("key")).limit(k))


def share_of_total(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Count / total for the top k keys (procedure mix)."""
    return top_keys_by_count(df, key, k).select("key", "share")


def sum_by_side(df: DataFrame, side: str, pnl: str) -> DataFrame:
    """Coerced PnL per side (sides with NULL excluded, as groupby does)."""
    return (df.filter(F.col(side).isNotNull()).groupBy(F.col(side).cast("string").alias("side"))
              .agg(F.sum(coerced0(df, pnl)).alias("pnl")))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows per normalised status class."""
    return df.groupBy(status_class(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def status_rates(df: DataFrame, status: str) -> DataFrame:
    """Cancellation and no-show rates over all rows."""
    s = status_class(status)
    return df.agg(
        ratio_max1(F.count_if(s == "cancelled"), F.count(F.lit(1))).alias("cancellation_rate"),
        ratio_max1(F.count_if(s == "no_show"), F.count(F.lit(1))).alias("no_show_rate"))


def flag_rate(df: DataFrame, flag: str) -> DataFrame:
    """Share of rows whose flag reads as yes/abnormal."""
    return df.agg(ratio_max1(F.count_if(yes_flag(flag)), F.count(F.lit(1))).alias("abnormal_percent"))


def order_rates(df: DataFrame, status: str | None = None) -> DataFrame:
    """Fill and rejection rates from the first column whose name holds
    'status' (substring tests; 'unfilled' counts as filled, as in the
    reference)."""
    status = status or next(filter(lambda c: "status" in c.lower(), df.columns), None)
    n = F.count(F.lit(1))
    if status is None:
        return df.agg(n.alias("total_orders"))
    s = F.lower(F.col(status).cast("string"))
    s = F.coalesce(s, F.lit("none"))
    return df.agg(
        n.alias("total_orders"),
        F.coalesce(safe_ratio(F.count_if(s.rlike("filled|complete")), n), F.lit(0.0)).alias("fill_rate"),
        F.coalesce(safe_ratio(F.count_if(s.rlike("reject|cancel")), n), F.lit(0.0)).alias("rejection_rate"))


def repeat_rate(df: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id appears more than once / all rows, in one grouped pass."""
    per = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(ratio_max1(_repeated(), F.coalesce(F.sum("n"), F.lit(0))).alias("repeat_patient_rate"))


def _repeated() -> Column:
    """Rows of non-NULL ids that occur more than once, over per-id counts ``n``."""
    return F.coalesce(F.sum(F.when(F.col("id").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0))


def unique_count(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct non-NULL ids."""
    return df.agg(F.countDistinct(id_col).alias("unique_patients"))


def revenue_totals(df: DataFrame, paid: str | None, billed: str | None) -> DataFrame:
    """Paid sum, billed sum, outstanding = billed - paid, average per
    visit (paid, else billed)."""
    return visit_measures(df, paid, billed)


def visit_measures(df: DataFrame, paid: str | None = None, billed: str | None = None,
                   status: str | None = None, patient: str | None = None) -> DataFrame:
    """G13, G8 and G11 together: the table is read once.  With a patient
    column, rows are first added up per patient (partial aggregation before the
    shuffle)."""
    one = F.lit(1)
    measures = {"n": F.count(one)}
    if paid:
        measures["paid"] = F.sum(coerced0(df, paid))
    if billed:
        measures["billed"] = F.sum(coerced0(df, billed))
    if status:
        cls = status_class(status)
        measures["cancelled"] = F.count_if(cls == "cancelled")
        measures["no_show"] = F.count_if(cls == "no_show")
    per = df.groupBy(*([F.col(patient).alias("id")] if patient else [])).agg(*[m.alias(k) for k, m in measures.items()])
    repeat = [_repeated().alias("repeated")] if patient else []
    total = per.agg(*[F.sum(k).alias(k) for k in measures], *repeat)
    visits = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    out = {"total_visits": visits}
    if paid:
        out["total_revenue_collected"] = F.col("paid")
    if billed:
        out["total_revenue_billed"] = F.col("billed")
    if paid and billed:
        out["outstanding_amount"] = F.col("billed") - F.col("paid")
    if paid or billed:
        out["avg_revenue_per_visit"] = ratio_max1(F.col("paid" if paid else "billed"), visits)
    if status:
        out["cancellation_rate"] = ratio_max1(F.coalesce("cancelled", F.lit(0)), visits)
        out["no_show_rate"] = ratio_max1(F.coalesce("no_show", F.lit(0)), visits)
    if patient:
        out["repeat_patient_rate"] = ratio_max1(F.col("repeated"), visits)
    return total.select(*[v.alias(k) for k, v in out.items()])


def trade_stats(df: DataFrame, pnl: str) -> DataFrame:
    """Count, total, win rate, average win / loss, profit factor
    (NULL without losses).  A PnL of exactly 0 is a loss."""
    df = df.select(coerced0(df, pnl).alias("p"))
    p = F.col("p")
    n = F.count(F.lit(1))
    win = F.when(p > 0, p)
    loss = F.when(p <= 0, p)
    gross_loss = F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    return df.agg(
        n.alias("total_trades"),
        F.sum(p).alias("total_pnl"),
        ratio_max1(F.count(win), n).alias("win_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.when(gross_loss > 0, F.coalesce(F.sum(win), F.lit(0.0)) / gross_loss).alias("profit_factor"))


def earliest_at(label: Column, value: Column, order: list[str], largest: bool) -> Column:
    """Aggregate: the label where ``value`` is largest (or smallest); ties go to
    the earliest row in ``order``."""
    key = F.struct((-value if largest else value).alias("v"), *[F.col(c) for c in order])
    return F.min_by(label, F.when(value.isNotNull(), key))


def monthly_stats(df: DataFrame, pnl: str | None = None, trades: str | None = None,
                  fees: str | None = None, steps: str | None = None, epsilon: str | None = None,
                  blocked: str | None = None, equity: str | None = None, drawdown: str | None = None,
                  month: str | None = None) -> DataFrame:
    """Every measure of a monthly table in one aggregate.  ``month``
    labels and orders the best, worst, first and last rows."""
    named = {"pnl": pnl, "trades": trades, "fees": fees, "steps": steps, "epsilon": epsilon, "blocked": blocked,
             "equity": equity, "drawdown": drawdown}
    d = df.select(*[number_of(df, c).alias(k) for k, c in named.items() if c],
                  *([F.col(month).cast("string").alias("month")] if month else []))
    v = {k: F.col(k) for k, c in named.items() if c}
    cols = {"total_months": F.count(F.lit(1))}
    if pnl:
        cols |= {"total_realized_pnl": F.coalesce(F.sum(v["pnl"]), F.lit(0.0)),
                 "avg_realized_pnl_per_month": F.coalesce(F.avg(v["pnl"]), F.lit(0.0)),
                 "std_realized_pnl": F.coalesce(F.stddev_samp(v["pnl"]), F.lit(0.0))}
    if trades:
        cols |= {"total_trades": F.sum(v["trades"]).cast("long"), "avg_trades_per_month": F.avg(v["trades"]),
                 "max_trades_per_month": F.max(v["trades"]).cast("long"),
                 "min_trades_per_month": F.min(v["trades"]).cast("long")}
    if fees:
        cols |= {"total_fees_paid": F.sum(v["fees"]), "avg_fees_per_month": F.avg(v["fees"])}
    if steps:
        cols |= {"total_training_steps": F.sum(v["steps"]).cast("long"),
                 "avg_training_steps_per_month": F.avg(v["steps"])}
    if epsilon:
        cols["avg_epsilon"] = F.avg(v["epsilon"])
    if blocked:
        cols |= {"total_blocked_trades": F.sum(v["blocked"]).cast("long"), "avg_blocked_per_month": F.avg(v["blocked"])}
    if month:
        label, order = F.col("month"), ["month"]
        if pnl:
            cols |= {"best_month_realized_pnl": earliest_at(label, v["pnl"], order, True),
                     "best_month_realized_pnl_value": F.max(v["pnl"]),
                     "worst_month_realized_pnl": earliest_at(label, v["pnl"], order, False),
                     "worst_month_realized_pnl_value": F.min(v["pnl"])}
        if equity:
            cols |= {"best_month_end_equity": earliest_at(label, v["equity"], order, True),
                     "best_month_end_equity_value": F.max(v["equity"]),
                     "worst_month_end_equity": earliest_at(label, v["equity"], order, False)}
        if drawdown:
            cols |= {"worst_drawdown_month": earliest_at(label, v["drawdown"], order, False),
                     "worst_drawdown_pct": F.min(v["drawdown"])}
        if epsilon:
            cols |= {"_first": F.min_by("epsilon", "month"), "_last": F.max_by("epsilon", "month")}
    if drawdown:
        cols["max_drawdown_pct"] = F.min(v["drawdown"])
    out = d.agg(*[c.alias(k) for k, c in cols.items()])
    if pnl and fees:
        s = F.col("total_realized_pnl")
        out = out.withColumn("fees_as_pct_of_pnl",
                             F.when(s != 0, F.col("total_fees_paid") / F.abs(s + 0.001) * 100)
                              .otherwise(F.lit(0.0)))
    if pnl and drawdown:
        out = out.withColumn("pnl_to_max_drawdown_ratio", F.when(
            F.col("max_drawdown_pct") < 0, F.abs("total_realized_pnl") / F.abs("max_drawdown_pct")))
    if month and epsilon:
        out = out.withColumn("epsilon_trend", F.when(F.col("avg_epsilon").isNotNull(), epsilon_label("_first", "_last")))
    return out.drop("_first", "_last")


def epsilon_label(first, last) -> Column:
    """The trend label with what it says about exploration."""
    # What a falling and a rising exploration rate are called.
    trend = trend_label(first, last)
    return (F.when(trend == "decreasing", "decreasing (exploration reduced)")
            .when(trend == "increasing", "increasing (exploration increased)").otherwise(trend))


def best_worst(df: DataFrame, label: str, value: str, order: list[str]) -> DataFrame:
    """Label and value at the maximum and minimum of ``value``; ties go to
    the earliest row in ``order``.  One aggregate."""
    v, name = number_of(df, value), F.col(label).cast("string")
    return df.agg(earliest_at(name, v, order, True).alias("best_label"), F.max(v).alias("best_value"),
                  earliest_at(name, v, order, False).alias("worst_label"), F.min(v).alias("worst_value"))


def first_last_trend(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Trend from the first and last value in order."""
    key = F.struct(*[F.col(c) for c in order])
    v = number_of(df, value)
    one = df.agg(F.min_by(v, key).alias("first_value"), F.max_by(v, key).alias("last_value"))
    return one.withColumn("trend", trend_label("first_value", "last_value"))


def with_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Share of the grand total, the total attached as a one-row
    broadcast (its size is one row by construction)."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, safe_ratio(F.col(value), F.col("_total"))) \
             .drop("_total")

"""Domain tables derived from the driver's parquet tables.

The reference reads one uploaded clinic or trading file; the driver tables are
an order/lineitem/events star.  Each function here derives the domain table an
operator expects with plain projections (and one join), so every query still
reads the whole given tables and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str, procedure: bool = False) -> DataFrame:
    """Clinic visits/billing: one row per order.  The procedure, where asked
    for, is the customer's market segment (orders joined to customer)."""
    o = table(spark, sf_dir, "orders")
    extra = []
    if procedure:
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        o = o.join(c, o.o_custkey == c.c_custkey, "left")
        extra = [F.col("c_mktsegment").alias("procedure")]
    return o.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("visit_id"),
        F.col("o_orderdate").alias("datetime"),
        F.col("o_orderpriority").alias("doctor"),
        *extra,
        F.when(F.col("o_orderstatus") == "P", "no show")
         .when(F.col("o_orderstatus") == "O", "cancelled")
         .when(F.col("o_orderstatus") == "F", "completed")
         .otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("billed_amount"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
         .otherwise(F.lit(0.0)).alias("paid_amount"),
    )


VISITS_SQL = """
SELECT o_custkey AS patient_id, o_orderkey AS visit_id, o_orderdate AS datetime,
       o_orderpriority AS doctor, c_mktsegment AS procedure,
       CASE o_orderstatus WHEN 'P' THEN 'no show' WHEN 'O' THEN 'cancelled'
            WHEN 'F' THEN 'completed' ELSE o_orderstatus END AS status,
       o_totalprice AS billed_amount,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS paid_amount
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""


def lab_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("patient_id"),
        F.col("event_type").alias("test_name"),
        F.col("value").alias("test_value"),
        F.lit("mg/dL").alias("unit"),
        F.when(F.col("value") > 50, "yes").otherwise("no").alias("abnormal_flag"),
    )


LAB_SQL = """
SELECT event_id, user_id AS patient_id, event_type AS test_name, value AS test_value,
       'mg/dL' AS unit, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS abnormal_flag
FROM events
"""


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("ts").alias("datetime"),
                    F.col("value").alias("heart_rate"))


VITALS_SQL = "SELECT event_id, ts AS datetime, value AS heart_rate FROM events"


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from lineitem.  (datetime, l_orderkey, l_linenumber, l_partkey,
    symbol) is a total order of the rows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").alias("datetime"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
        F.col("l_suppkey").alias("symbol"),
        F.col("l_returnflag").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("realized_pnl"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fees"),
    )


TRADE_ORDER = ["datetime", "l_orderkey", "l_linenumber", "l_partkey", "symbol"]

TRADES_SQL = """
SELECT l_shipdate AS datetime, l_orderkey, l_linenumber, l_partkey, l_suppkey AS symbol,
       l_returnflag AS side, l_quantity AS qty,
       l_extendedprice * (l_discount - 0.05) AS realized_pnl,
       l_extendedprice * l_tax AS fees
FROM lineitem
"""


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily equity: 1e8 plus the running total of daily trade PnL.  The daily
    rollup bounds the ordered window by the number of days, not trades."""
    from pyspark.sql import Window as W
    daily = (trade_log(spark, sf_dir)
             .groupBy(F.to_date("datetime").alias("datetime"))
             .agg(F.sum("realized_pnl").alias("daily_pnl")))
    w = W.orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("datetime", (F.lit(1e8) + F.sum("daily_pnl").over(w)).alias("equity"))


EQUITY_SQL = """
SELECT datetime, 1e8 + sum(daily_pnl) OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
FROM (SELECT CAST(l_shipdate AS DATE) AS datetime,
             sum(l_extendedprice * (l_discount - 0.05)) AS daily_pnl
      FROM lineitem GROUP BY 1)
"""


def backtest_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly backtest summary: trades, PnL, fees, end equity, the worst
    drawdown fraction (from daily equity) and training telemetry per month
    (quantity as steps, mean discount as epsilon, returned lines as blocked).
    lineitem is read once: the days, which bound the ordered window, are rolled
    up to months."""
    from pyspark.sql import Window as W
    t = table(spark, sf_dir, "lineitem")
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))
    daily = t.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(pnl).alias("realized_pnl"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("total_fees"), F.sum("l_quantity").alias("steps"),
        F.sum("l_discount").alias("epsilon"), F.count_if(F.col("l_returnflag") == "R").alias("blocked"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    daily = daily.withColumn("equity", F.lit(1e8) + F.sum("realized_pnl").over(w))
    daily = daily.withColumn("peak", F.max("equity").over(w))
    return (daily.groupBy(F.date_format("day", "yyyy-MM").alias("month"))
            .agg(F.sum("trades").alias("trades"), F.sum("realized_pnl").alias("realized_pnl"),
                 F.sum("total_fees").alias("total_fees"), F.max_by("equity", "day").alias("end_equity"),
                 F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("max_drawdown"),
                 F.sum("steps").cast("long").alias("agent_train_steps"),
                 (F.sum("epsilon") / F.sum("trades")).alias("avg_epsilon"),
                 F.sum("blocked").alias("blocked_total")))


BACKTEST_SQL = """
WITH t AS (SELECT l_shipdate AS datetime, l_extendedprice * (l_discount - 0.05) AS realized_pnl,
                  l_extendedprice * l_tax AS fees, l_quantity, l_discount, l_returnflag FROM lineitem),
m AS (SELECT strftime(datetime, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS trades,
             sum(realized_pnl) AS realized_pnl, sum(fees) AS total_fees,
             CAST(sum(l_quantity) AS BIGINT) AS agent_train_steps, avg(l_discount) AS avg_epsilon,
             CAST(count_if(l_returnflag = 'R') AS BIGINT) AS blocked_total FROM t GROUP BY 1),
eq AS (""" + EQUITY_SQL + """),
eqp AS (SELECT *, max(equity) OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM eq),
me AS (SELECT strftime(datetime, '%Y-%m') AS month, arg_max(equity, datetime) AS end_equity,
              min((equity - peak) / peak) AS max_drawdown FROM eqp GROUP BY 1)
SELECT m.*, me.end_equity, me.max_drawdown FROM m JOIN me USING (month)
"""


def vitals_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals in which the readings of 'error' events are missing."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("datetime"),
                    F.when(F.col("event_type") != "error", F.col("value")).alias("heart_rate"))


VITALS_GAPS_SQL = """
SELECT event_id, ts AS datetime, CASE WHEN event_type <> 'error' THEN value END AS heart_rate FROM events
"""


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A billing table: a date and one amount per order, every seventh missing."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("datetime"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"))


BILLING_SQL = """
SELECT o_orderdate AS datetime, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amount FROM orders
"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "FILLED")
         .when(F.col("o_orderstatus") == "O", "open")
         .otherwise("Rejected").alias("status"),
        F.col("o_orderpriority").alias("order_type"),
        F.col("o_totalprice").alias("quantity"),
    )


ORDERS_SQL = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_orderstatus = 'F' THEN 'FILLED' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'Rejected' END AS status,
       o_orderpriority AS order_type, o_totalprice AS quantity
FROM orders
"""


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from events: first, max, min and last value by time, and the
    row count as volume.  Ties in ts are broken by event_id."""
    e = table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    return (e.groupBy(F.to_date("ts").alias("datetime"))
            .agg(F.min_by("value", key).alias("open"),
                 F.max("value").alias("high"),
                 F.min("value").alias("low"),
                 F.max_by("value", key).alias("close"),
                 F.count("*").alias("volume")))


OHLCV_SQL = """
SELECT CAST(ts AS DATE) AS datetime, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
FROM events GROUP BY 1
"""


def generic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a generic table, with derived missing values (zero discount
    -> NULL, 'N' flag -> NULL) and one constant column so profiles see them."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice",
        F.expr("nullif(l_discount, 0.0)").alias("l_discount"),
        "l_tax",
        F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
        F.lit("lineitem").alias("l_source"),
        F.when(F.col("l_quantity") >= 50, "bulk").alias("l_bulk_note"),
    )


GENERIC_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       nullif(l_discount, 0.0) AS l_discount, l_tax, nullif(l_returnflag, 'N') AS l_returnflag,
       l_linestatus, l_shipdate, 'lineitem' AS l_source,
       CASE WHEN l_quantity >= 50 THEN 'bulk' END AS l_bulk_note
FROM lineitem
"""

"""Registered queries for cleaning, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.functions.scalars import epoch_ntz, epoch_seconds, number_of, yes_flag
from tablesight.operators import clean as C
from tablesight.operators import infer as I
from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded

GEN = f"({S.GENERIC_SQL})"
GEN_ALL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
           "l_tax, l_returnflag, l_linestatus, l_shipdate, l_source, l_bulk_note")

# Display-style headers laid over lineitem columns (P1 / P2 inputs).
MESSY = [("l_orderkey", "Order Key"), ("l_extendedprice", "Net Price ($)"),
         ("l_shipdate", "  Ship\tDate "), ("l_returnflag", "A b"), ("l_linestatus", "a_b"),
         ("l_tax", "%%%"), ("l_quantity", "Qty-Ordered")]


def _messy(spark, d):
    li = S.table(spark, d, "lineitem")
    return li.select(*[F.col(c).alias(n) for c, n in MESSY])


@query("p1_normalize_columns", """
SELECT l_orderkey AS order_key, l_extendedprice AS net_price_, l_shipdate AS ship_date,
       l_returnflag AS a_b, l_linestatus AS a_b__2, l_tax AS col, l_quantity AS qtyordered FROM lineitem""")
def p1(spark, d):
    return C.normalize_columns(_messy(spark, d))


@query("p2_sanitize_columns", """
SELECT l_orderkey AS Order_Key, l_extendedprice AS Net_Price_, l_shipdate AS Ship_Date,
       l_returnflag AS A_b, l_tax AS col, l_quantity AS "Qty-Ordered" FROM lineitem""")
def p2(spark, d):
    # case is kept, so leave out the header that differs from "A b" only by case
    return C.sanitize_columns(_messy(spark, d).drop("a_b"))


@query("p3_drop_constant_columns", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate, l_bulk_note FROM {GEN} g""")
def p3(spark, d):
    return C.drop_constant_columns(S.generic_table(spark, d))


@query("p4_impute_median", f"""
WITH g AS {GEN}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)) AS l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate, l_source, l_bulk_note FROM g""")
def p4(spark, d):
    return C.impute_median(S.generic_table(spark, d))


_RATIO = """SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE l_tax / l_discount END AS l_tax_per_discount
FROM lineitem"""


@query("p5_replace_infinite", f"""
WITH r AS ({_RATIO})
SELECT l_orderkey, l_linenumber, l_partkey,
       round(CASE WHEN l_tax_per_discount IS NULL OR isinf(l_tax_per_discount)
             THEN (SELECT quantile_cont(l_tax_per_discount, 0.5) FROM r) ELSE l_tax_per_discount END, 12)
         AS l_tax_per_discount
FROM r""")
def p5(spark, d):
    li = S.table(spark, d, "lineitem")
    r = li.select("l_orderkey", "l_linenumber", "l_partkey",
                  F.when(F.col("l_discount") == 0, F.lit(float("inf")))
                   .otherwise(F.col("l_tax") / F.col("l_discount")).alias("l_tax_per_discount"))
    return rounded(C.replace_infinite(r), {"l_tax_per_discount": 12})


@query("p6_fill_categorical", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       coalesce(l_returnflag, 'missing') AS l_returnflag, coalesce(l_linestatus, 'missing') AS l_linestatus,
       l_shipdate, coalesce(l_source, 'missing') AS l_source, coalesce(l_bulk_note, 'missing') AS l_bulk_note
FROM {GEN} g""")
def p6(spark, d):
    return C.fill_categorical(S.generic_table(spark, d))


@query("p7_model_frame", """
SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, l_tax FROM lineitem""")
def p7(spark, d):
    """Model frame of lineitem with an id, a date, a constant and a mostly
    missing number beside the numbers that vary."""
    li = S.table(spark, d, "lineitem")
    t = li.select(F.col("l_orderkey").alias("order_id"), "l_quantity", "l_extendedprice",
                  F.expr("nullif(l_discount, 0.0)").alias("l_discount"), "l_tax", "l_shipdate", "l_returnflag",
                  F.lit(1.0).alias("unit"), F.when(F.col("l_quantity") >= 40, F.col("l_tax")).alias("sparse"))
    # numbers of few values count as numbers here: a model frame keeps them
    types = I.types_dict(I.infer_schema(t, unique_id_rule=False, max_onehot_categories=0))
    return C.model_frame(t, types)


_DATES = """SELECT o_orderkey, o_orderdate,
       CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT03:04:05Z') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 23:30:00-02:00')
         WHEN 4 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 5 THEN strftime(o_orderdate, '%Y/%m/%d 01:02:03')
         ELSE 'unknown' END AS order_date
FROM orders"""


@query("p8_parse_datetimes", """
SELECT o_orderkey,
  CASE o_orderkey % 13 WHEN 2 THEN day + INTERVAL '3 hours 4 minutes 5 seconds'
    WHEN 3 THEN day + INTERVAL '25 hours 30 minutes' WHEN 5 THEN day + INTERVAL '1 hours 2 minutes 3 seconds'
    WHEN 6 THEN NULL WHEN 9 THEN day + INTERVAL '10 hours 11 minutes' WHEN 10 THEN day + INTERVAL '13 hours 5 minutes'
    ELSE day END AS order_date,
  day AS ship_date, CASE WHEN date_part('day', day) <= 12 OR o_orderkey % 2 = 0 THEN day END AS due_date
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders)""")
def p8(spark, d):
    """A column of many spellings, one of day-first dates (of which those after
    the 12th show it), and one of month-first dates with every second date after
    the 12th left out."""
    o = S.table(spark, d, "orders")
    forms = ["M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T03:04:05Z'", "yyyy-MM-dd' 23:30:00-02:00'", "dd.MM.yyyy",
             "yyyy/MM/dd' 01:02:03'", None, "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd' 10:11'", "M/d/yyyy' 1:05 PM'",
             "M/d/yy", "MMMM dd yyyy"]
    text = F.lit("unknown")
    for i, form in enumerate(forms):
        if form:
            text = F.when(F.col("o_orderkey") % 13 == i, F.date_format("o_orderdate", form)).otherwise(text)
    early = (F.dayofmonth("o_orderdate") <= 12) | (F.col("o_orderkey") % 2 == 0)
    return C.parse_datetimes(o.select(
        "o_orderkey", text.alias("order_date"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("ship_date"),
        F.when(early, F.date_format("o_orderdate", "MM-dd-yyyy")).alias("due_date")))


@query("p9_parse_epoch", """
SELECT event_id, CAST(make_timestamp(epoch_us(date_trunc('second', ts))) AS TIMESTAMP) AS ts_s,
       CAST(make_timestamp((epoch_us(ts) // 1000) * 1000) AS TIMESTAMP) AS ts_ms,
       CASE WHEN event_id % 3 <> 0 THEN CAST(make_timestamp((epoch_us(ts) // 1000) * 1000) AS TIMESTAMP) END AS ts_some,
       event_id + 1000000000000000000 AS key FROM events""")
def p9(spark, d):
    """Seconds, milliseconds, milliseconds with values out of range, and keys
    near 1e18, which are no times."""
    e = S.table(spark, d, "events")
    ms = F.floor(F.timestamp_diff("MICROSECOND", epoch_ntz(), F.col("ts")) / 1000).cast("long")
    t = e.select("event_id", epoch_seconds("ts").alias("ts_s"), ms.alias("ts_ms"),
                 F.when(F.col("event_id") % 3 == 0, F.lit(10 ** 17)).otherwise(ms).alias("ts_some"),
                 (F.col("event_id") + F.lit(10 ** 18)).alias("key"))
    return C.parse_epoch(t)


_NUMTXT = """SELECT l_orderkey, l_linenumber, l_partkey,
       CASE l_linenumber WHEN 7 THEN CAST(l_quantity AS VARCHAR) || 'f'
                         WHEN 6 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e0 '
                         WHEN 5 THEN 'n/a' WHEN 4 THEN '' WHEN 3 THEN '-Inf' WHEN 2 THEN 'infinity'
                         ELSE CAST(l_quantity AS VARCHAR) END AS qty_text, l_quantity > 25 AS big
FROM lineitem"""


@query("p10_to_number", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN regexp_full_match(qty_text, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')
            THEN TRY_CAST(trim(qty_text) AS DOUBLE)
            WHEN qty_text = '-Inf' THEN CAST('-inf' AS DOUBLE) WHEN qty_text = 'infinity' THEN CAST('inf' AS DOUBLE) END AS qty,
       CAST(big AS DOUBLE) AS big
FROM ({_NUMTXT}) x""")
def p10(spark, d):
    li = S.table(spark, d, "lineitem")
    q = F.col("l_quantity")
    t = li.select("l_orderkey", "l_linenumber", "l_partkey",
                  F.when(F.col("l_linenumber") == 7, F.concat(q.cast("string"), F.lit("f")))
                   .when(F.col("l_linenumber") == 6, F.concat(F.lit(" "), q.cast("long").cast("string"), F.lit("e0 ")))
                   .when(F.col("l_linenumber") == 5, F.lit("n/a"))
                   .when(F.col("l_linenumber") == 4, F.lit(""))
                   .when(F.col("l_linenumber") == 3, F.lit("-Inf")).when(F.col("l_linenumber") == 2, F.lit("infinity"))
                   .otherwise(q.cast("string")).alias("qty"), (q > 25).alias("big"))
    return C.coerce_numeric(t, ["qty", "big"])


@query("p11_clip_quantiles", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS plo, quantile_cont(l_extendedprice, 0.99) AS phi,
                  quantile_cont(l_quantity, 0.01) AS qlo, quantile_cont(l_quantity, 0.99) AS qhi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(least(greatest(l_extendedprice, plo), phi), 6) AS l_extendedprice,
       round(least(greatest(l_quantity, qlo), qhi), 6) AS l_quantity
FROM lineitem, q""")
def p11(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_extendedprice", "l_quantity")
    out = C.clip_quantiles(li, ["l_extendedprice", "l_quantity"])
    return rounded(out, {"l_extendedprice": 6, "l_quantity": 6})


@query("p12_drop_high_cardinality", """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def p12(spark, d):
    return C.drop_high_cardinality(S.table(spark, d, "customer"), limit=200)


@query("p13_apply_mapping", f"""
SELECT datetime, symbol, qty, side, realized_pnl, fees FROM ({S.TRADES_SQL}) t""")
def p13(spark, d):
    """Trades with display-style names, brought to their canonical keys."""
    t = S.trade_log(spark, d).withColumnsRenamed({
        "datetime": "Trade Time", "symbol": "Ticker", "qty": "Size (units)", "side": "Direction",
        "realized_pnl": "Net PnL", "fees": "Commission"})
    roles = I.infer_roles(t.columns)
    keys = ["datetime", "symbol", "qty", "side", "realized_pnl", "fees", "equity"]
    return C.apply_mapping(t, {k: roles.get(k) for k in keys})


@query("p14_drop_nulls", f"""
SELECT {GEN_ALL} FROM {GEN} g WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL""")
def p14(spark, d):
    return C.drop_nulls(S.generic_table(spark, d), ["l_discount", "l_returnflag"])


@query("p15_comparison_filter", f"""
SELECT l_orderkey, l_linenumber, l_partkey, symbol, round(realized_pnl, 6) AS realized_pnl
FROM ({S.TRADES_SQL}) t WHERE coalesce(realized_pnl, 0.0) <= 0""")
def p15(spark, d):
    t = S.trade_log(spark, d)
    p = F.coalesce(number_of(t, "realized_pnl"), F.lit(0.0))
    return rounded(t.filter(p <= 0).select("l_orderkey", "l_linenumber", "l_partkey", "symbol",
                                           "realized_pnl"), {"realized_pnl": 6})


@query("p16_membership_filter", f"""
SELECT event_id, patient_id, test_name FROM ({S.LAB_SQL}) l
WHERE lower(CAST(abnormal_flag AS VARCHAR)) IN ('1','true','yes','y','abnormal')""")
def p16(spark, d):
    return S.lab_results(spark, d).filter(yes_flag("abnormal_flag")).select("event_id", "patient_id", "test_name")


@query("p17_substring_filter", f"""
SELECT order_id, status FROM ({S.ORDERS_SQL}) o WHERE regexp_matches(lower(status), 'filled|complete')""")
def p17(spark, d):
    o = S.order_log(spark, d)
    return o.filter(F.lower("status").rlike("filled|complete")).select("order_id", "status")


@query("p18_without_target", """
SELECT doc_id, lang, source, n_chars, toxic FROM documents JOIN labels USING (doc_id)""")
def p18(spark, d):
    sup = (S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
           .select("doc_id", "lang", "source", "n_chars", "toxic", "quality"))
    return C.without(sup, "quality")


@query("q15_clean_table", f"""
WITH g AS {GEN}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)) AS discount_pct,
       l_tax, coalesce(l_returnflag, 'missing') AS return_flag, l_linestatus, l_shipdate,
       coalesce(l_bulk_note, 'missing') AS bulk_note FROM g""")
def q15(spark, d):
    """Display names to normal ones, a constant column dropped, medians and
    'missing' filled in."""
    g = S.generic_table(spark, d).withColumnsRenamed(
        {"l_discount": " Discount (pct)", "l_returnflag": "Return Flag", "l_bulk_note": "Bulk Note!"})
    return C.clean_table(g)


@query("q15_clean_visits", f"""
WITH v AS ({S.VISITS_SQL}), w AS (SELECT * REPLACE (CASE WHEN visit_id % 5 <> 0 THEN billed_amount END AS billed_amount,
  CASE WHEN visit_id % 4 <> 0 THEN status END AS status) FROM v)
SELECT patient_id, visit_id, datetime, doctor, procedure, coalesce(status, 'missing') AS status,
       round(coalesce(billed_amount, (SELECT quantile_cont(billed_amount, 0.5) FROM w)), 6) AS billed_amount, paid_amount FROM w""")
def q15b(spark, d):
    v = S.visits(spark, d, True)
    v = v.withColumns({"billed_amount": F.when(F.col("visit_id") % 5 != 0, F.col("billed_amount")),
                       "status": F.when(F.col("visit_id") % 4 != 0, F.col("status"))})
    return rounded(C.clean_table(v), {"billed_amount": 6})

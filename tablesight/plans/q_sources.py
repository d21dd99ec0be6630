"""Registered queries for sources, sinks and run listing.

Each query first writes files derived from the given tables (in a fresh
folder under the session's ``spark.checkpoint.dir``, the cluster's shared
folder) and then reads them back through the source under test, so the work
grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesight.operators import topk as T
from tablesight.plans import runs as R
from tablesight.plans import standins as S
from tablesight.plans.registry import query
from tablesight.session import checkpoint_dir
from tablesight.sources import readers as RD
from tablesight.sources import sinks as SK


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def _buckets(key: str, width: int):
    """A number per range of keys, so that files grow in number with the data."""
    return F.floor(F.col(key) / width).cast("long")


@query("s1_read_delimited", """
SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus,
       CASE WHEN o_orderkey % 5 = 0 THEN 'say "hi", now' || chr(10) || 'or; never' ELSE 'plain' END AS note,
       CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 101 <> 0""")
def s1(spark, d):
    """Raw files, one per range of keys, by turns with semicolons and commas:
    quoted delimiters, doubled quotes and line breaks, short rows and rows that
    are too long (dropped, though the extra field is empty)."""
    path = scratch(spark, "orders_raw")
    o = S.table(spark, d, "orders").withColumn("bucket", _buckets("o_orderkey", 2000))
    def joined(*cells):
        return F.when(F.col("bucket") % 2 == 0, F.concat_ws(";", *cells)).otherwise(F.concat_ws(",", *cells))

    note = F.when(F.col("o_orderkey") % 5 == 0, F.lit('"say ""hi"", now\nor; never"')).otherwise(F.lit("plain"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    line = joined(F.col("o_orderkey").cast("string"), cents, "o_orderstatus", note,
                  F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")),
                  F.when(F.col("o_orderkey") % 101 == 0, F.lit("")),
                  F.when((F.col("o_orderkey") % 101 == 0) & (F.col("o_orderkey") % 11 == 0), F.lit("")))
    header = joined(*[F.lit(c) for c in ("o_orderkey", "cents", "o_orderstatus", "note", "o_orderpriority")])
    first = F.row_number().over(W.partitionBy("bucket").orderBy("o_orderkey")) == 1   # one file's rows
    (o.select("bucket", F.when(first, F.concat(header, F.lit("\n"), line)).otherwise(line).alias("value"))
     .write.partitionBy("bucket").text(path))
    return RD.read_delimited(spark, f"{path}/*/*.txt")   # delimiters found by S2


@query("s1b_read_delimited_capped", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def s1b(spark, d):
    path = scratch(spark, "customer_csv")
    S.table(spark, d, "customer").select("c_custkey", "c_name").write.options(**SK.CSV).csv(path)
    return RD.read_delimited(spark, path, sep=",", max_rows=100, order=["c_custkey"])


@query("s2_detect_delimiters", """
SELECT * FROM (VALUES ('orders', ','), ('customer', '\t'), ('part', '|')) t(dataset, delimiter)""")
def s2(spark, d):
    base = scratch(spark, "mixed")
    for name, sep in (("orders", ","), ("customer", "\t"), ("part", "|")):
        S.table(spark, d, name).write.option("header", "true").option("sep", sep).csv(f"{base}/{name}")
    found = RD.detect_delimiters(spark, f"{base}/*/*.csv")
    ds = F.regexp_extract("file", r"/(orders|customer|part)/", 1)
    return found.select(ds.alias("dataset"), "delimiter").distinct()


@query("s4_read_parquet", "SELECT * FROM lineitem")
def s4(spark, d):
    return RD.read_parquet(spark, f"{d}/lineitem.parquet")


@query("s5_read_json_table", """
SELECT c_custkey, c_name, c_acctbal AS "account.balance", c_mktsegment AS "account.segment" FROM customer""")
def s5(spark, d):
    """Customers as JSON documents {"data": [...]} of at most 1,000 rows each
    (grouped by key range, so no document grows with the table)."""
    path = scratch(spark, "customer_docs")
    c = S.table(spark, d, "customer")
    docs = (c.groupBy(_buckets("c_custkey", 1000).alias("chunk"))
             .agg(F.to_json(F.struct(F.collect_list(F.struct(
                 "c_custkey", "c_name",
                 F.struct(F.col("c_acctbal").alias("balance"),
                          F.col("c_mktsegment").alias("segment")).alias("account"))).alias("data")))
                  .alias("value")))
    docs.write.partitionBy("chunk").text(path)
    return RD.read_json_table(spark, f"{path}/*/*.txt")


@query("s6_read_jsonl", """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 97 = 0 THEN '{"o_orderkey' END AS raw
FROM orders WHERE NOT (o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0)""")
def s6(spark, d):
    """Orders as JSON Lines with blank and broken lines mixed in."""
    path = scratch(spark, "orders_jsonl")
    o = S.table(spark, d, "orders")
    js = F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    line = (F.when(F.col("o_orderkey") % 97 == 0, F.substring(js, 1, 12))
             .when(F.col("o_orderkey") % 89 == 0, F.lit("   "))
             .otherwise(js))
    o.select(line.alias("value")).write.text(path)
    return RD.read_jsonl(spark, path)


@query("s5_read_json_scalars", """
SELECT CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'status ' || o_orderstatus FROM orders GROUP BY o_orderstatus""")
def s5b(spark, d):
    """JSON documents that are one number or one string."""
    path = scratch(spark, "scalars")
    o = S.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("string").alias("n"))
    docs = o.select("o_orderstatus", F.explode(F.array("n", F.concat(F.lit('"status '), "o_orderstatus", F.lit('"')))).alias("value"))
    docs = docs.withColumn("part", F.length("value"))
    docs.write.partitionBy("o_orderstatus", "part").text(path)
    return RD.read_json_table(spark, f"{path}/*/*/*.txt")


@query("s7_flatten_structs", """
SELECT l_orderkey AS "key.order", l_linenumber AS "key.line", l_quantity AS "amounts.quantity",
       l_extendedprice AS "amounts.price" FROM lineitem""")
def s7(spark, d):
    li = S.table(spark, d, "lineitem")
    nested = li.select(F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"),
                       F.struct(F.col("l_quantity").alias("quantity"),
                                F.col("l_extendedprice").alias("price")).alias("amounts"))
    return RD.flatten_structs(nested)


@query("s8_read_documents", """
SELECT CAST(doc_id // 50 AS BIGINT) AS bucket, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS text_md5
FROM documents GROUP BY 1""")
def s8(spark, d):
    """Documents of a range of ids written to one file, read back whole."""
    path = scratch(spark, "docs")
    docs = S.table(spark, d, "documents").select(_buckets("doc_id", 50).alias("bucket"), "doc_id", "text")
    docs = docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    docs.select("bucket", F.col("text").alias("value")).write.partitionBy("bucket").text(path)
    got = RD.read_documents(spark, f"{path}/*/*.txt")
    return got.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("s9_open_source", "SELECT p_partkey, p_name, p_retailprice FROM part")
def s9(spark, d):
    path = scratch(spark, "part_parquet") + ".parquet"
    S.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.parquet(path)
    return RD.open_source(spark, path)


@query("s9_open_source_by_extension", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, c_custkey, c_name, c_acctbal FROM customer" for k in ("csv", "jsonl", "parquet")))
def s9b(spark, d):
    """One table in three formats, told apart by the files' extensions."""
    base = scratch(spark, "formats")
    c = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.write.options(**SK.CSV).csv(f"{base}/csv")
    c.write.json(f"{base}/jsonl")
    c.write.parquet(f"{base}/parquet")
    kinds = {"csv": ("csv/*.csv", None), "jsonl": ("jsonl/*.json", "jsonl"), "parquet": ("parquet/*.parquet", None)}
    parts = [RD.open_source(spark, f"{base}/{glob}", override).select(F.lit(k).alias("kind"), "c_custkey", "c_name", "c_acctbal")
             for k, (glob, override) in kinds.items()]
    return T.union_all(*parts)


@query("s10_cap_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 150")
def s10(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return RD.cap_rows(o, 150, [F.desc("o_totalprice"), "o_orderkey"])


@query("k1_write_cleaned", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, coalesce(note, 'missing') AS note FROM (
SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'a "quoted", note' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN 'back\\slash' END AS note
FROM orders)""")
def k1(spark, d):
    """A cleaned table with quotes, line breaks and backslashes, written and
    read back."""
    from tablesight.operators.clean import clean_table
    path = scratch(spark, "cleaned")
    key = F.col("o_orderkey") % 4
    note = F.when(key == 0, F.lit('a "quoted", note')).when(key == 1, F.lit("two\nlines")).when(key == 2, F.lit("back\\slash"))
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", note.alias("Note"))
    SK.write_cleaned(clean_table(o), path)
    got = RD.read_delimited(spark, path, sep=",")
    return got.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("k2_write_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def k2(spark, d):
    path = scratch(spark, "preview")
    SK.write_preview(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, ["o_orderkey"])
    return RD.read_delimited(spark, path, sep=",")


@query("k4_list_runs", f"""
WITH v AS ({S.VISITS_SQL}), n AS (SELECT count(*) AS n FROM v)
SELECT 1 AS pos, 'run_b' AS run_id, '2024-02-01T00:00:00' AS created_at, 'visits' AS input, 'universal' AS mode, n AS rows,
       8 AS cols, printf('Dataset: %d rows × 8 cols. 0 constant columns dropped. 4 numeric columns.', n) AS summary FROM n
UNION ALL SELECT 2, 'run_a', '2024-01-01T00:00:00', 'visits', 'clinic', n, 8,
       'Visits/appointments table: trends by day/week/month.' FROM n""")
def k4(spark, d):
    """K3 + K4 + T7: two pack runs written as reports, listed newest first."""
    base = scratch(spark, "runs")
    v = S.visits(spark, d, True)
    R.report(v, "clinic", base, "visits", "run_a", "2024-01-01T00:00:00")
    R.report(v, "universal", base, "visits", "run_b", "2024-02-01T00:00:00")
    listed = R.list_runs(spark, base).select("run_id", "created_at", "input", "mode", "rows", "cols", "summary")
    # the listing is one row per run; number it as it came
    return listed.select((F.monotonically_increasing_id() + 1).cast("int").alias("pos"), "*")

"""Registered query for the incremental (streaming) period totals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded
from tablesight.session import checkpoint_dir
from tablesight.streaming.incremental import period_totals_stream, run_to_table


@query("st1_stream_period_totals", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS amount,
       count(*) AS rows
FROM orders GROUP BY 1""")
def st1(spark, d):
    """Orders land as several files (one per order status); the stream sums
    them per month as they are picked up, eight files per micro-batch."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    o = S.table(spark, d, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    o.write.partitionBy("o_orderstatus").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").drop("o_orderstatus").schema
    stream = period_totals_stream(spark, f"{base}/in/*", schema, "o_orderdate", "o_totalprice",
                                  "month", max_files_per_trigger=8)
    out = run_to_table(stream, f"st1_{uuid.uuid4().hex[:8]}", f"{base}/ckpt")
    return rounded(out.select("period", "amount", "rows"), {"amount": 2}).withColumn("rows", F.col("rows"))

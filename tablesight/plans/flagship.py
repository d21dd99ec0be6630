"""The minimum slice: orders -> clean_table -> per-month billing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.functions.scalars import number_of, period_start
from tablesight.operators.clean import clean_table
from tablesight.plans.registry import query, rounded

FLAGSHIP_SQL = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       round(sum(o_totalprice), 2) AS billed, count(*) AS orders,
       round(sum(o_totalprice) / count(*), 4) AS mean_per_order
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
"""


def monthly_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    clean = clean_table(raw)
    amount = number_of(clean, "o_totalprice")
    out = (clean.select(period_start("o_orderdate", "month").alias("month"), amount.alias("_a"))
                .filter(F.col("month").isNotNull())
                .groupBy("month")
                .agg(F.sum("_a").alias("billed"), F.count(F.lit(1)).alias("orders"))
                .withColumn("mean_per_order", F.col("billed") / F.col("orders")))
    return rounded(out, {"billed": 2, "mean_per_order": 4})


query("q0_flagship_monthly_billing", FLAGSHIP_SQL)(monthly_billing)

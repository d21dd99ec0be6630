"""Incremental measures over a folder of arriving files.

The reference reads a large CSV in chunks only to bound memory, then works
on the whole table.  The Spark counterpart is a Structured Streaming query
over the input folder: each micro-batch reads the new files, the per-period
totals are kept as streaming state (checkpointed to the shared checkpoint
folder, so a restarted job resumes where it stopped), and ``availableNow``
processes everything present and stops, like one batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.functions.scalars import number_of, period_start


def period_totals_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str, amount: str,
                         period: str = "month", fmt: str = "parquet",
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (period, amount, rows) over files in ``path``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(path)
    return (src.select(period_start(F.col(ts), period).alias("period"),
                       F.coalesce(number_of(src, amount), F.lit(0.0)).alias("_a"))
               .filter(F.col("period").isNotNull())
               .groupBy("period")
               .agg(F.sum("_a").alias("amount"), F.count(F.lit(1)).alias("rows")))


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Process all available input (restartable from ``checkpoint``) into an
    in-memory table and return it as a DataFrame.  The table holds the query's
    groups only: one row per period, however many rows arrive."""
    q = (stream.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.table(name)

"""Exact histogram of encoded lengths (operator 7).

Documents are counted by their number of tokens.  Sums from each length upward
then answer, for any context limit L: how many documents reach it, how many
tokens they hold, and what is left when every document is cut at L.

The histogram has one row per distinct length.  Suffix sums run in blocks of
BLOCK lengths: a window inside each block, plus the totals of the blocks above,
which are one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesight.session import scratch_table


BLOCK = 256


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length (a null length counts as 0).

    ``n_tokens`` the length; ``n_docs`` of that length; ``docs_at_least`` and
    ``tokens_at_least`` over documents of that length or more;
    ``truncated_total`` tokens kept when every document is cut at this length;
    ``quantile`` share of documents at or below it.  Empty input: no rows.
    """
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    hist = scratch_table(
        lengths.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long")), "lengths")
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    inside = (Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = hist.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("tokens").over(inside)).alias("tokens_at_least"))
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least")
         + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs"))
         / F.col("all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits, whether or not a document has that length:
    documents longer than the limit, and the tokens kept when cut at it."""
    columns = []
    for i, limit in enumerate(limits):
        longer = F.col("n_tokens") > limit
        columns += [
            F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias(f"d{i}"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(f"t{i}")]
    rows = F.array(*[F.struct(F.lit(limit).cast("long").alias("context_limit"),
                              F.col(f"d{i}").alias("docs_cut"), F.col(f"t{i}").alias("truncated_total"))
                     for i, limit in enumerate(limits)])
    return histogram.agg(*columns).select(F.inline(rows))


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of documents stay within."""
    return histogram.filter(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]

"""Chart data (C1-C11): the rows each chart needs, as DataFrames.  Drawing is
left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.functions.scalars import number_of, parse_ts
from tablesight.operators import ordered as W
from tablesight.operators.profile import correlation_pairs


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; the last bin is closed.
    Empty bins are listed with count 0.  When min = max every value falls in
    the middle bin of [min - 0.5, max + 0.5] (as numpy does)."""
    v = number_of(df, column)
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    bounds = vals.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    bounds = bounds.select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    # one-row bounds: broadcast is bounded by construction
    b = F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int") + 1
    counts = (vals.crossJoin(F.broadcast(bounds))
                  .select(F.least(b, F.lit(bins)).alias("bin"))
                  .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, "bin", "left")
                .select("bin",
                        (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_lo"),
                        (F.col("lo") + width * F.col("bin")).alias("bin_hi"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def time_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Parsed time, numeric value, NULLs dropped, sorted by time."""
    return (df.select(parse_ts(x, df.schema[x].dataType).alias("x"), number_of(df, y).alias("y"))
              .dropna().orderBy("x"))


def bar_top(df: DataFrame, key: str, y: str, k: int = 20) -> DataFrame:
    """Coerced sum per key, top k."""
    from tablesight.operators.grouped import top_keys_by_sum
    return top_keys_by_sum(df, key, y, k, "y")


def corr_heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """C4: the full correlation matrix in long form (both orders and the
    diagonal, which is 1 for a column that varies).  One pass gives the pairs,
    each mirrored, and each column with itself."""
    pairs = correlation_pairs(df, columns, with_self=True)
    same = F.col("col_a") == F.col("col_b")
    cell = lambda a, b, c: F.struct(F.col(a).alias("col_a"), F.col(b).alias("col_b"), c.alias("corr"))
    corr = F.col("corr")
    return pairs.select(F.inline(F.when(same, F.array(cell("col_a", "col_b", F.when(corr.isNotNull(), 1.0))))
                                 .otherwise(F.array(cell("col_a", "col_b", corr), cell("col_b", "col_a", corr)))))


def scatter_points(df: DataFrame, x: str, y: str, fraction: float = 1.0, seed: int = 42,
                   key: list[str] | None = None) -> DataFrame:
    """Numeric pairs, NULLs dropped; a repeatable hash sample of
    ``fraction`` of the rows when below 1 (T5)."""
    pts = df.select(*(key or []), number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna(subset=["x", "y"])
    if fraction >= 1.0:
        return pts
    from tablesight.operators.topk import hash_sample
    return hash_sample(pts, fraction, key or ["x", "y"], seed)


def equity_points(df: DataFrame, order: list[str], y: str) -> DataFrame:
    """Numeric values, NULLs dropped, with their position."""
    d = df.select(*order, number_of(df, y).alias("y")).filter(F.col("y").isNotNull())
    return W.row_position(d, order, "index").select("index", "y")


def drawdown_points(df: DataFrame, order: list[str], y: str) -> DataFrame:
    """Running total of y, its running peak, and the difference."""
    d = df.select(*order, number_of(df, y).alias("y"))
    return W.drawdown_of_cumsum(d, order, "y")


def candles(df: DataFrame, time: str = "datetime", k: int | None = 200) -> DataFrame:
    """The first k bars by time (None: all) with the up/down flag and the body."""
    o, c = number_of(df, "open"), number_of(df, "close")
    bars = (df.select(time, o.alias("open"), number_of(df, "high").alias("high"),
                      number_of(df, "low").alias("low"), c.alias("close"))
              .orderBy(time))
    return ((bars.limit(k) if k else bars)
              .withColumn("up", F.col("close") >= F.col("open"))
              .withColumn("body_bottom", F.least("open", "close"))
              .withColumn("body_height", F.abs(F.col("close") - F.col("open"))))


def monthly_series(df: DataFrame, month: str, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """C11: month with each series, missing values as ``fill`` (None: kept
    missing, as the summary table has them)."""
    def value(c):
        return number_of(df, c) if fill is None else F.coalesce(number_of(df, c), F.lit(fill))

    return df.select(F.col(month).cast("string").alias("month"), *[value(c).alias(c) for c in columns])

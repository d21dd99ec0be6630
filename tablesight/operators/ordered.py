"""Ordered-series operators (W1-W10) that scale past one task.

A window with ``ORDER BY`` and no ``PARTITION BY`` moves every row into one
task.  Instead, :func:`ranged` deals rows out by ranges of the full order key
(tie-breakers included, so a hot timestamp is still split), numbers the ranges
and writes the rows to the shared folder: the one range exchange, whose outcome
every later step then reads as data.  :func:`scan` runs windows inside the
ranges and fixes each range up with a carry from the ranges before it:

1. one row per range with its totals, maxima and last values;
2. a prefix scan over those rows (as many as ranges, not as rows);
3. a broadcast join of the carries back to the rows.

Further scans of the same :class:`Ranged` rows reuse their partitioning.  When
the data has a natural key (symbol, account, patient) pass ``partition_by`` and
a plain partitioned window is used instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.functions.scalars import safe_ratio
from tablesight.session import scratch_table

_UNB = W.unboundedPreceding


@dataclass(frozen=True)
class Scan:
    """One running quantity.  kind: sum, max, min, ffill, lag, row_number;
    max_of_sum (the largest running sum so far); peak_at (struct of the largest
    value so far and the last position that holds it)."""
    kind: str
    value: str | None
    out: str


@dataclass(frozen=True)
class Ranged:
    """Rows with their range number ``__b`` and the order within ranges."""
    frame: DataFrame
    order: tuple[str, ...]

    def rows(self) -> DataFrame:
        return self.frame.drop("__b")


def total_order(df: DataFrame, first: list[str]) -> list[str]:
    """``first``, then every other orderable column as tie-breaker: rows equal in
    all of them are alike, so their order does not matter."""
    rest = [f.name for f in df.schema.fields
            if f.name not in first and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*first, *rest]


def ranged(df: DataFrame, order: list[str], n_buckets: int | None = None) -> Ranged:
    """Deal rows out by ranges of a total order of them."""
    if not order:
        raise ValueError("an ordered operator needs an explicit order key")
    n = int(n_buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = df.repartitionByRange(max(1, n), *keys).withColumn("__b", F.spark_partition_id())
    return Ranged(scratch_table(rows, "ranged"), tuple(order))


def _running(kind: str, value: Column, w) -> Column:
    run = w.rowsBetween(_UNB, 0)
    if kind in ("sum", "max_of_sum"):
        return F.sum(value).over(run)
    if kind == "max":
        return F.max(value).over(run)
    if kind == "min":
        return F.min(value).over(run)
    if kind == "ffill":
        return F.last(value, ignorenulls=True).over(run)
    if kind == "lag":
        return F.lag(value, 1).over(w)
    if kind == "row_number":
        return F.row_number().over(w)
    raise ValueError(f"unknown scan kind {kind!r}")


def _plus(a: Column, b: Column) -> Column:
    """Sum of two running sums, either of which may still be NULL."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _locals(scans: list[Scan], d: DataFrame, w) -> DataFrame:
    """Running values inside each range: __l_<out>, and __m_<out> for the
    scans that take a maximum of another running value."""
    d = d.withColumns({"__rn": F.row_number().over(w), **{
        f"__l_{s.out}": _running(s.kind, F.col(s.value) if s.value else None, w) for s in scans if s.kind != "peak_at"}})
    second = {f"__m_{s.out}": F.max(f"__l_{s.out}").over(w.rowsBetween(_UNB, 0)) for s in scans if s.kind == "max_of_sum"}
    second |= {f"__l_{s.out}": F.max(_peak(F.col(s.value), F.col("__rn"))).over(w.rowsBetween(_UNB, 0))
               for s in scans if s.kind == "peak_at"}
    return d.withColumns(second) if second else d


def _peak(value: Column, at: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value"), at.cast("long").alias("at")))


def scan(rows: Ranged, scans: list[Scan]) -> Ranged:
    """Add running columns in the rows' total order; the same as the plain
    window over all rows."""
    w = W.partitionBy("__b").orderBy(*[F.col(c).asc_nulls_first() for c in rows.order])
    local = _locals(scans, rows.frame, w)
    lags = [s for s in scans if s.kind == "lag"]
    held = [c for c in local.columns if c.startswith(("__l_", "__m_"))]
    last = F.max_by(F.struct("__rn", *held, *[F.col(s.value).alias(f"__v_{s.out}") for s in lags]), "__rn")
    per_range = local.groupBy("__b").agg(last.alias("x")).select("__b", "x.*")

    before, prior = W.orderBy("__b").rowsBetween(_UNB, -1), W.orderBy("__b")   # a row per range
    per_range = per_range.withColumn("__n", F.coalesce(F.sum("__rn").over(before), F.lit(0)))
    carries, second = {}, {}
    for s in scans:
        own, c = F.col(f"__l_{s.out}"), f"__c_{s.out}"
        if s.kind in ("sum", "max_of_sum"):
            carries[c] = F.sum(own).over(before)
        elif s.kind in ("max", "min"):
            carries[c] = getattr(F, s.kind)(own).over(before)
        elif s.kind == "ffill":
            carries[c] = F.last(own, ignorenulls=True).over(before)
        elif s.kind == "lag":
            carries[c] = F.lag(f"__v_{s.out}", 1).over(prior)
        if s.kind == "max_of_sum":
            second[f"__d_{s.out}"] = F.max(_plus(F.col(f"__m_{s.out}"), F.col(c))).over(before)
        elif s.kind == "peak_at":
            second[c] = F.max(F.when(own.isNotNull(), F.struct(
                own["value"].alias("value"), (own["at"] + F.col("__n")).alias("at")))).over(before)
    carry = per_range.withColumns(carries) if carries else per_range
    carry = carry.withColumns(second) if second else carry
    carry = carry.select("__b", "__n", *carries, *second)

    joined = local.join(F.broadcast(carry), "__b", "left")
    outs = {}
    for s in scans:
        lv, cv = F.col(f"__l_{s.out}"), F.col(f"__c_{s.out}")
        if s.kind == "row_number":
            v = lv + F.col("__n")
        elif s.kind == "sum":
            v = _plus(lv, cv)
        elif s.kind == "max":
            v = F.greatest(lv, cv)
        elif s.kind == "min":
            v = F.least(lv, cv)
        elif s.kind == "ffill":
            v = F.coalesce(lv, cv)
        elif s.kind == "lag":
            v = F.when(F.col("__rn") == 1, cv).otherwise(lv)
        elif s.kind == "max_of_sum":
            v = F.greatest(_plus(F.col(f"__m_{s.out}"), cv), F.col(f"__d_{s.out}"))
        else:
            v = F.greatest(F.when(lv.isNotNull(), F.struct(
                lv["value"].alias("value"), (lv["at"] + F.col("__n")).alias("at"))), cv)
        outs[s.out] = v
    spent = [c for c in joined.columns if c.startswith(("__l_", "__m_", "__c_", "__d_"))] + ["__rn", "__n"]
    return Ranged(joined.withColumns(outs).drop(*spent), rows.order)


def ordered_scan(df: DataFrame, order: list[str], scans: list[Scan],
                 partition_by: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Add running columns to ``df`` in the total order ``order``, within each
    key of ``partition_by`` where given."""
    if not order:
        raise ValueError("an ordered operator needs an explicit order key")
    if not partition_by:
        return scan(ranged(df, order, n_buckets), scans).rows()
    w = W.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = _locals(scans, df, w)
    outs = {s.out: F.col(f"__m_{s.out}" if s.kind == "max_of_sum" else f"__l_{s.out}") for s in scans}
    spent = [c for c in local.columns if c.startswith(("__l_", "__m_"))] + ["__rn"]
    return local.withColumns(outs).drop(*spent)


# --------------------------------------------------------------------------
# W1-W10 as user-level operators
# --------------------------------------------------------------------------

def cum_sum(df: DataFrame, order: list[str], value: str, out: str = "cum_sum",
            partition_by=None, n_buckets=None) -> DataFrame:
    """Running sum; NULL values count as 0 (the reference fills before)."""
    d = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    return ordered_scan(d, order, [Scan("sum", "_v", out)], partition_by, n_buckets).drop("_v")


def forward_fill(df: DataFrame, order: list[str], value: str, out: str | None = None,
                 fill_rest: float | None = 0.0, partition_by=None, n_buckets=None) -> DataFrame:
    """Last non-NULL value so far, then ``fill_rest`` for leading NULLs."""
    out = out or value
    d = ordered_scan(df, order, [Scan("ffill", value, "_ff")], partition_by, n_buckets)
    filled = F.col("_ff") if fill_rest is None else F.coalesce(F.col("_ff"), F.lit(fill_rest))
    return d.withColumn(out, filled).drop("_ff")


def drawdown(df: DataFrame, order: list[str], value: str, partition_by=None,
             n_buckets=None) -> DataFrame:
    """Running peak and value - peak per row."""
    d = ordered_scan(df, order, [Scan("max", value, "peak")], partition_by, n_buckets)
    return d.withColumn("drawdown", F.col(value) - F.col("peak"))


def returns(df: DataFrame, order: list[str], value: str, out: str = "ret",
            partition_by=None, n_buckets=None) -> DataFrame:
    """V / previous v - 1; the first row has no return; a previous value
    of 0 gives NULL (pandas gives inf)."""
    d = ordered_scan(df, order, [Scan("lag", value, "_prev")], partition_by, n_buckets)
    return (d.withColumn(out, safe_ratio(F.col(value), F.col("_prev")) - 1)
             .drop("_prev"))


def row_position(df: DataFrame, order: list[str], out: str = "row_pos",
                 partition_by=None, n_buckets=None) -> DataFrame:
    """0-based position of each row in the order."""
    d = ordered_scan(df, order, [Scan("row_number", None, "__pos")], partition_by, n_buckets)
    return d.withColumn(out, F.col("__pos") - 1).drop("__pos")


def start_end(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """First, last, change and change % of |first| (one aggregate, no
    window)."""
    key = F.struct(*[F.col(c) for c in order])
    return (df.agg(F.min_by(value, key).alias("start_value"),
                   F.max_by(value, key).alias("end_value"))
              .withColumn("change", F.col("end_value") - F.col("start_value"))
              .withColumn("change_pct", F.when(F.col("start_value") != 0,
                                               F.col("change") / F.abs(F.col("start_value")) * 100)))


def volatility(returns_df: DataFrame, ret: str = "ret") -> DataFrame:
    """W4 + W5: std of returns (x100, and annualised with sqrt(252)) when more
    than one return exists; Sharpe proxy when more than 30 and std > 0."""
    r = F.col(ret)
    agg = returns_df.filter(r.isNotNull()).agg(
        F.count(r).alias("n_returns"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    n, m, s = F.col("n_returns"), F.col("_m"), F.col("_s")
    return agg.select(
        "n_returns",
        F.when(n > 1, s * 100).alias("daily_return_volatility"),
        F.when(n > 1, s * F.sqrt(F.lit(252.0)) * 100).alias("annualized_volatility"),
        F.when((n > 30) & (s > 0), m / s * F.sqrt(F.lit(252.0))).alias("sharpe_ratio_proxy"),
    )


def longest_run(peaks: DataFrame, value: str, peak: str, position: str,
                partition_by: list[str] | None = None) -> DataFrame:
    """Longest run of consecutive rows below the running peak, from each row's
    position and the last position that held the peak."""
    run = F.when(F.col(value) < F.col(f"{peak}.value"), F.col(position) - F.col(f"{peak}.at"))
    return peaks.groupBy(*(partition_by or [])).agg(
        F.coalesce(F.max(run), F.lit(0)).cast("long").alias("longest_drawdown_rows"))


def longest_drawdown(df: DataFrame, order: list[str], value: str,
                     partition_by=None, n_buckets=None) -> DataFrame:
    """Longest run of consecutive rows strictly below the running peak.
    Rows without a value are left out.  One range exchange of the order key and
    the value."""
    d = df.select(*dict.fromkeys([*(partition_by or []), *order, value])).filter(F.col(value).isNotNull())
    d = ordered_scan(d, order, [Scan("peak_at", value, "_peak"), Scan("row_number", None, "_pos")],
                     partition_by, n_buckets)
    return longest_run(d, value, "_peak", "_pos", partition_by)


def drawdown_of_cumsum(df: DataFrame, order: list[str], value: str,
                       partition_by=None, n_buckets=None) -> DataFrame:
    """Running total (NULL as 0), its running peak, and total - peak, from
    one range exchange: the peak carried into a range is the largest carried
    total plus largest total inside an earlier range."""
    d = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    d = ordered_scan(d, order, [Scan("sum", "_v", "cum_value"), Scan("max_of_sum", "_v", "cum_peak")],
                     partition_by, n_buckets).drop("_v")
    return d.withColumn("cum_drawdown", F.col("cum_value") - F.col("cum_peak"))

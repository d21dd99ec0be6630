"""Exact quantiles (linear interpolation, as pandas / ``quantile_cont``) in two
passes over the data, whatever its size or its repeated values.

1. Sketch: one aggregate gives, per column, the row count and a KLL sketch, which
   brackets each wanted rank (``MARGIN`` times the sketch's rank error to either
   side).  Sketches merge, so the pass is one partial aggregate a task.
2. Count: the brackets cut a column's range into segments.  Tasks count rows per
   segment in Arrow batches and, inside brackets, rows per value; only the latter
   (about two per cent of the rows a bracket, each distinct value once a batch) are
   shuffled.  A value repeated by a third of all rows is one record a batch.

A bracket is cut into ``SLICES`` equal parts of the doubles' order-preserving
64-bit images, so that no spread of values, infinities included, puts it all into
one.  The counted table is written to the shared folder and read twice: once for
row counts per segment and slice (the only rows the driver sees), once for the
running count inside the slices that hold a wanted rank.  Should a bracket miss
its rank, the call is repeated with wider ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesight.session import scratch_table

#: The sketch's k.  Its rank error is about 2.3 / k^0.9 (a thousandth here).
DEFAULT_ACCURACY = 4096
MARGIN = 2.0
SLICES = 256


def _c(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def rank_error(k: int) -> float:
    """The normalised rank error of a KLL sketch (Karnin, Lang & Liberty 2016,
    with the constants of its public implementation)."""
    return 2.296 / k ** 0.9021


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    accuracy: int = DEFAULT_ACCURACY, extra: list | None = None,
                    margin: float = MARGIN) -> dict[tuple[str, float], float | None]:
    """Return {(column, p): value}; NULLs are ignored, an empty column gives
    None.  ``extra`` aggregates ride along in the first pass; their row is
    returned under the key ``"extra"``."""
    if not columns or not probs:
        return {}
    half = margin * rank_error(accuracy)
    ends = [x for p in probs for x in (max(0.0, p - half), min(1.0, p + half))]
    ranks_wanted = F.array(*[F.lit(x) for x in ends])
    aggs = list(extra or [])
    for i, c in enumerate(columns):
        v = _c(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.kll_sketch_agg_double(v, accuracy).alias(f"q{i}")]
    one = df.agg(*aggs)
    row = one.select(*[c for c in one.columns if not _is_sketch(c, len(columns))], *[
        F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"q{i}", ranks_wanted)).alias(f"q{i}")
        for i in range(len(columns))]).first()
    result: dict = {"extra": row} if extra else {}
    ranks, segments = {}, {}
    for i, c in enumerate(columns):
        if not row[f"n{i}"]:
            result.update({(c, p): None for p in probs})
            continue
        segments[i] = _merged([(row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]) for j in range(len(probs))])
        for p in probs:
            pos = (row[f"n{i}"] - 1) * p
            k = int(math.floor(pos))
            ranks[i, p] = (k, pos - k, min(k + 1, row[f"n{i}"] - 1))
    if not ranks:
        return result
    values = _values_at(df, columns, segments, {(i, r) for (i, _), (k, _, k1) in ranks.items() for r in (k, k1)})
    for (i, p), (k, frac, k1) in ranks.items():
        v0, v1 = values.get((i, k)), values.get((i, k1))
        if v0 is None or v1 is None:
            return exact_quantiles(df, columns, probs, accuracy, extra, margin * 10)
        result[(columns[i], p)] = v0 + (v1 - v0) * frac if frac else v0
    return result


def _is_sketch(name: str, n: int) -> bool:
    return name[:1] == "q" and name[1:].isdigit() and int(name[1:]) < n


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted brackets with overlapping ones joined."""
    out: list[list[float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def image(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers of the same order."""
    bits = np.asarray(values, np.float64).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-2 ** 63)).view(np.uint64)


def slice_numbers(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which of SLICES equal parts of [low, high], by images, values lie in."""
    first, last = (int(image(np.array([x]))[0]) for x in (low, high))
    step = (last - first) // SLICES + 1
    return ((image(values) - np.uint64(first)) // np.uint64(step)).astype(np.int32)


def _values_at(df: DataFrame, columns, segments: dict, wanted: set) -> dict:
    """{(column index, rank): value} for the ranks that fall inside brackets."""
    held = list(segments)
    source = df.select(*[(_c(columns[i]).cast("double") + 0.0).alias(f"v{i}") for i in held])   # -0.0 equals 0.0

    def run(batches):
        outside = {i: np.zeros(2 * len(b) + 1, np.int64) for i, b in segments.items()}
        form = pa.schema([("i", pa.int32()), ("s", pa.int32()), ("b", pa.int32()), ("v", pa.float64()), ("m", pa.int64())])
        for batch in batches:
            for at, i in enumerate(held):
                v = np.asarray(batch.column(at).drop_null())
                lows, highs = (np.array(x) for x in zip(*segments[i]))
                # brackets do not overlap: 2j+1 inside bracket j, even numbers between
                segment = np.searchsorted(lows, v, side="right") + np.searchsorted(highs, v, side="left")
                inside = segment % 2 == 1
                outside[i] += np.bincount(segment[~inside], minlength=len(outside[i]))
                if inside.any():
                    values, first, counts = np.unique(v[inside], return_index=True, return_counts=True)
                    s = segment[inside][first]
                    b = np.zeros(len(values), np.int32)
                    for j in np.unique(s):
                        b[s == j] = slice_numbers(values[s == j], *segments[i][j // 2])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), i, np.int32)), pa.array(s.astype(np.int32)), pa.array(b),
                         pa.array(values), pa.array(counts)], schema=form)
        for i, counts in outside.items():
            s = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), i, np.int32)), pa.array(s.astype(np.int32)), pa.array(np.zeros(len(s), np.int32)),
                 pa.nulls(len(s), pa.float64()), pa.array(counts[s])], schema=form)

    counted = scratch_table(
        source.mapInArrow(run, "i int, s int, b int, v double, m long")
        .groupBy("i", "s", "b", "v").agg(F.sum("m").alias("m")), "quantiles")
    before: dict = {}
    spots = []       # (column, segment, slice, rank, rank inside the slice)
    sums = counted.groupBy("i", "s", "b").agg(F.sum("m").alias("m")).collect()   # at most SLICES a bracket
    for r in sorted(sums, key=lambda r: (r["i"], r["s"], r["b"])):
        start = before.get(r["i"], 0)
        before[r["i"]] = start + r["m"]
        if r["s"] % 2:
            spots += [(r["i"], r["s"], r["b"], k, k - start) for i, k in wanted
                      if i == r["i"] and start <= k < start + r["m"]]
    if not spots:
        return {}
    want = df.sparkSession.createDataFrame(spots, "i int, s int, b int, k long, r long")
    part = W.partitionBy("i", "s", "b")
    held = counted.join(F.broadcast(want.select("i", "s", "b").distinct()), ["i", "s", "b"])
    held = held.withColumn("upto", F.sum("m").over(part.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    picked = (held.join(F.broadcast(want), ["i", "s", "b"])
              .filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("m"))))
    return {(r["i"], r["k"]): r["v"] for r in picked.select("i", "k", "v").collect()}

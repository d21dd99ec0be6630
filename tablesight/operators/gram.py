"""Moments of all pairs of many columns in one scan: blocked Gram matrices.

For columns x_i with missing values, the correlation of a pair takes the rows
where both are present.  With X the shifted values (0 where missing) and M the
mask of present ones, all pairs' counts, sums, squares and products are the
matrices M'M, X'M, (X*X)'M and X'X.  Tasks add them up over Arrow batches and emit
them in square blocks; blocks are added in two steps (first within slots of tasks,
then over the slots), each streaming its input, so no task ever holds more than
the blocks it was dealt, and a pair's correlation comes out of its block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Tasks whose blocks are added in one step.
SLOT_TASKS = 64
#: Rows that the shifts are taken from.
SHIFT_ROWS = 1000
#: A variance below this share of the mean square is rounding.
TINY = 1e-13
PARTS = 7   # counts, sums and squares of either side, products, rows with an infinity


def _shifts(numbers: DataFrame) -> list[float]:
    """A value of each column from near its middle: it only keeps the sums small."""
    head = numbers.limit(SHIFT_ROWS)
    finite = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in numbers.columns]
    row = head.agg(*[F.percentile_approx(v, 0.5).alias(c) for v, c in zip(finite, numbers.columns)]).first()
    return [0.0 if x is None else float(x) for x in row]


def block_correlations(numbers: list[Column], df: DataFrame, names: list[str], with_self: bool) -> DataFrame:
    """(col_a, col_b, corr) of every pair a < b (or a <= b), pairwise complete.
    A pair with a constant side or no complete row has NULL, one with an infinity
    in its rows NaN."""
    n = len(numbers)
    table = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers)])
    shifts = np.array(_shifts(table))
    edges = [(s, min(s + BLOCK, n)) for s in range(0, n, BLOCK)]
    pairs = [(a, b) for a in range(len(edges)) for b in range(a, len(edges))]

    def measure(batches):
        sums = None
        for batch in batches:
            x = np.empty((batch.num_rows, n))
            for i in range(n):
                x[:, i] = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
            endless = np.isinf(x).astype(float)
            there = (~np.isnan(x)).astype(float)
            x = np.where((there > 0) & (endless == 0), x - shifts, 0.0)
            square = x * x
            if sums is None:
                sums = {p: np.zeros((PARTS, edges[p[0]][1] - edges[p[0]][0], edges[p[1]][1] - edges[p[1]][0])) for p in pairs}
            for p in pairs:
                a, b = slice(*edges[p[0]]), slice(*edges[p[1]])
                total = sums[p]
                total[0] += there[:, a].T @ there[:, b]
                total[1] += x[:, a].T @ there[:, b]
                total[2] += there[:, a].T @ x[:, b]
                total[3] += square[:, a].T @ there[:, b]
                total[4] += there[:, a].T @ square[:, b]
                total[5] += x[:, a].T @ x[:, b]
                total[6] += endless[:, a].T @ there[:, b] + there[:, a].T @ endless[:, b]
        yield from _blocks(sums or {})

    def _blocks(sums):
        for (a, b), total in sums.items():
            yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()),
                                              "sums": pa.array([total.tobytes()], pa.binary())})

    def added(batches):
        out: dict = {}
        for batch in batches:
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sums"))):
                shape = (PARTS, edges[a][1] - edges[a][0], edges[b][1] - edges[b][0])
                total = np.frombuffer(raw).reshape(shape)
                out[a, b] = out[a, b] + total if (a, b) in out else total
        return out

    def merge(batches):
        yield from _blocks(added(batches))

    def correlate(batches):
        for (a, b), (count, sa, sb, qa, qb, product, endless) in added(batches).items():
            with np.errstate(divide="ignore", invalid="ignore"):
                va, vb = qa / count - (sa / count) ** 2, qb / count - (sb / count) ** 2
                va, vb = (np.where(v > TINY * q / count, v, 0.0) for v, q in ((va, qa), (vb, qb)))
                corr = (product / count - sa / count * sb / count) / np.sqrt(va * vb)
            corr = np.where(endless > 0, math.nan, corr)
            none = (count == 0) | ((endless == 0) & ((va == 0) | (vb == 0)))
            i, j = np.meshgrid(np.arange(*edges[a]), np.arange(*edges[b]), indexing="ij")
            kept = (i <= j) if with_self else (i < j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[kept], pa.int32()), pa.array(j[kept], pa.int32()), pa.array(corr[kept], mask=none[kept])],
                names=["i", "j", "corr"])

    blocks = table.mapInArrow(measure, "a int, b int, sums binary")
    slot = F.floor(F.spark_partition_id() / SLOT_TASKS)
    blocks = blocks.withColumn("slot", slot).repartition("a", "b", "slot").drop("slot").mapInArrow(merge, "a int, b int, sums binary")
    found = blocks.repartition("a", "b").mapInArrow(correlate, "i int, j int, corr double")
    labels = F.array(*[F.lit(c) for c in names])
    return found.select(F.get(labels, F.col("i")).alias("col_a"), F.get(labels, F.col("j")).alias("col_b"), "corr")

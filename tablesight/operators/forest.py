"""Random-forest regression on binned features (M6), a tree at a time in tasks.

MLlib takes every row past every tree once a level and shuffles the statistics of
all open nodes, slots x bins for each of them: with deep trees over many rows that
is most of the work.  But a tree sees binned features only, and the bins of a few
columns repeat: rows of the same bins (a *cell*) go the same way in every tree, so
a tree needs no more of them than the number and the sum of the labels that its
bootstrap drew.  Spark draws and adds these up; what a tree is grown from is then
bounded by CELLS, however many rows there are.

As in MLlib: a bootstrap of Poisson(1) draws of every row, BINS bins a number, a
third of the slots tried at each node, splits by variance, up to the given depth.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.operators.quantiles import exact_quantiles
from tablesight.session import scratch_table

#: Cells a tree may be grown from: some six megabytes a tree.
CELLS = 1 << 18
#: Bins of a number, as MLlib's maxBins.
BINS = 32
#: Groups of equal cell and label that one task draws for.
GROUPS_AT_ONCE = 1 << 14
#: Nodes whose slots are chosen at once.
NODES_AT_ONCE = 1 << 13
#: Gains this close to each other, relatively, are equal.
TIE = 1e-9


def thresholds(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """At most BINS - 1 ascending cuts of each column: between all of its values if
    they are few, else its quantiles."""
    few = {}
    for c in columns:
        values = [r[0] for r in df.select(c).filter(~F.isnan(c)).distinct().limit(BINS + 1).collect()]
        if len(values) <= BINS:
            values = sorted(values)
            few[c] = [a + (b - a) / 2 for a, b in zip(values, values[1:])]
    many = [c for c in columns if c not in few]
    cuts = exact_quantiles(df.select(*many), many, [i / BINS for i in range(1, BINS)]) if many else {}
    return [few[c] if c in few else sorted({cuts[c, i / BINS] for i in range(1, BINS)}) for c in columns]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < value)) if cuts else F.lit(0)


def cell_of(columns: list[str], cuts: list[list[float]], slots: list[tuple[str, int]]) -> tuple[Column, list[int]]:
    """(number of the row's cell, radices of its digits): a bin for each number,
    a slot (0: none) for each category."""
    digits = [_bin(F.col(c), at) for c, at in zip(columns, cuts)] + [F.col(c) + 1 for c, _ in slots]
    radices = [len(at) + 1 for at in cuts] + [size + 1 for _, size in slots]
    cell = F.lit(0).cast("long")
    for digit, radix in zip(digits, radices):
        cell = cell * F.lit(radix) + digit
    return cell.cast("long"), radices


def _chosen(rng, nodes: int, slots: int, tried: int) -> np.ndarray:
    """For each node, which slots are tried."""
    out = np.ones((nodes, slots), bool)
    if tried < slots:
        for start in range(0, nodes, NODES_AT_ONCE):
            at = np.argpartition(rng.random((min(NODES_AT_ONCE, nodes - start), slots), np.float32), tried, axis=1)
            np.put_along_axis(out[start:start + len(at)], at[:, tried:], False, axis=1)
    return out


def grow(codes: np.ndarray, radices: list[int], numbers: int, weight: np.ndarray, total: np.ndarray,
         rng, tried: int, depth: int) -> np.ndarray:
    """The prediction of one tree for each cell.  ``codes`` has a row for each column:
    the first ``numbers`` are split by a bin, the others by one slot against the rest
    (0 is no slot).  ``weight`` and ``total`` are the cells' draws and label sums; a
    cell without draws follows the splits of the others."""
    first = np.cumsum([0, *[1] * numbers, *[r - 1 for r in radices[numbers:]]])   # a column's first slot
    value = np.zeros(len(weight))
    at, node, nodes = np.arange(len(weight)), np.zeros(len(weight), np.int64), 1
    for level in range(depth + 1):
        drawn = weight[at] > 0
        w, s = (np.bincount(node, x[at], nodes) for x in (weight, total))
        value[at] = (s / np.maximum(w, 1))[node]
        # a node of one cell is a leaf
        alive = np.bincount(node[drawn], minlength=nodes) > 1
        if level == depth or not alive.any():
            break
        kept, name = alive[node], np.cumsum(alive) - 1
        at, node, drawn, w, s, nodes = at[kept], name[node[kept]], drawn[kept], w[alive], s[alive], int(alive.sum())
        chosen = _chosen(rng, nodes, int(first[-1]), tried)
        best, column, cut = TIE ** 2 * s * s / w, np.full(nodes, -1), np.zeros(nodes, np.int64)
        on, of = at[drawn], node[drawn]
        for j, radix in enumerate(radices):
            key = of * radix + codes[j, on]
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n, code = key[start] // radix, key[start] % radix
            left_w, left_s = (np.add.reduceat(x[on][order], start) for x in (weight, total))
            begin = np.append(True, n[1:] != n[:-1])
            if j < numbers:   # all bins up to this one
                run = np.cumsum(begin) - 1
                left_w, left_s = (np.cumsum(x) - (np.cumsum(x) - x)[begin][run] for x in (left_w, left_s))
                last = np.append(begin[1:], True)
                valid = ~last & chosen[n, first[j]]
            else:
                valid = (code > 0) & (left_w < w[n]) & chosen[n, first[j] + np.maximum(code, 1) - 1]
            n, code, left_w, left_s = n[valid], code[valid], left_w[valid], left_s[valid]
            right_w = w[n] - left_w
            gain = left_w * right_w / w[n] * (left_s / left_w - (s[n] - left_s) / right_w) ** 2
            top = np.zeros(nodes)
            np.maximum.at(top, n, np.nan_to_num(gain))
            # of equal gains the first counts, whatever the order of the sums
            better = top > best * (1 + TIE)
            won = np.flatnonzero(better[n] & (gain >= (top * (1 - TIE))[n]))[::-1]
            column[n[won]], cut[n[won]] = j, code[won]
            best = np.where(better, top, best)
        kept, name = (column >= 0)[node], np.cumsum(column >= 0) - 1
        at, node = at[kept], node[kept]
        code = codes[column[node], at]
        left = np.where(column[node] < numbers, code <= cut[node], code == cut[node])
        node, nodes = 2 * name[node] + ~left, 2 * int((column >= 0).sum())
        if not nodes:
            break
    return value


def cell_groups(train: DataFrame, asked: DataFrame) -> DataFrame:
    """(cell, y, n): how many training rows have this cell and label, and the cells
    asked for (n = 0)."""
    rows = train.select("cell", "y", F.lit(1).alias("n")).unionByName(
        asked.select("cell", F.lit(None).cast("double").alias("y"), F.lit(0).alias("n")))
    return scratch_table(rows.groupBy("cell", "y").agg(F.sum("n").alias("n")), "cells")


def predictions(groups: DataFrame, radices: list[int], numbers: int, n_trees: int, max_depth: int, seed: int) -> DataFrame:
    """(cell, prediction) of a forest fitted to ``cell_groups``.

    The draws of a group follow from its cell and label alone, and a tree's choices
    from its number, so neither partitioning nor a retry changes the forest.  A task
    takes whole trees, one after the other, and adds up what they predict."""
    mean = groups.filter("n > 0").agg(F.try_divide(F.sum(F.col("y") * F.col("n")), F.sum("n")), F.count(F.lit(1))).first()
    middle, size = mean
    if not size:
        raise ValueError("no training row has a target")
    slots = numbers + sum(r - 1 for r in radices[numbers:])
    tried = slots if n_trees == 1 else math.ceil(slots / 3)
    lanes = min(n_trees, 4 * groups.sparkSession.sparkContext.defaultParallelism)

    def draw(batches):
        for batch in batches:
            cell, n, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "key"))
            y = np.where(n > 0, batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False) - middle, 0.0)
            if not len(cell):
                continue
            draws = np.zeros((len(cell), n_trees))
            for i in np.flatnonzero(n):
                draws[i] = np.random.Generator(np.random.Philox(key=int(key[i]) % (1 << 64))).poisson(n[i], n_trees)
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sums = np.add.reduceat(draws * y[:, None], start, axis=0)
            draws = np.add.reduceat(draws, start, axis=0)
            cells = cell[start].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_trees), pa.int32()), pa.array([cells] * n_trees, pa.binary()),
                 pa.array([draws[:, t].tobytes() for t in range(n_trees)], pa.binary()),
                 pa.array([sums[:, t].tobytes() for t in range(n_trees)], pa.binary())],
                names=["tree", "cells", "draws", "sums"])

    def trees(batches):
        all_cells = values = None

        def grown(tree, parts):
            cell, draws, sums = (np.concatenate([np.frombuffer(p[i], t) for p in parts])
                                 for i, t in enumerate((np.int64, np.float64, np.float64)))
            cells, where = np.unique(cell, return_inverse=True)
            codes, rest = [], cells
            for radix in reversed(radices):
                codes.append(rest % radix)
                rest = rest // radix
            return cells, grow(np.array(codes[::-1]), radices, numbers, np.bincount(where, draws), np.bincount(where, sums),
                               np.random.default_rng([seed, tree]), tried, max_depth)

        now, parts = None, []
        for batch in batches:
            for tree, *part in zip(*(batch.column(c).to_pylist() for c in ("tree", "cells", "draws", "sums"))):
                if tree != now and parts:
                    all_cells, value = grown(now, parts)
                    values = value if values is None else values + value
                    parts = []
                now = tree
                parts.append(part)
        if parts:
            all_cells, value = grown(now, parts)
            values = value if values is None else values + value
            yield pa.RecordBatch.from_arrays([pa.array(all_cells), pa.array(values)], names=["cell", "value"])

    drawn = (groups.withColumn("key", F.xxhash64(F.lit(seed), "cell", "y"))
             .repartitionByRange(max(1, math.ceil(size / GROUPS_AT_ONCE)), "cell", "y").sortWithinPartitions("cell", "y")
             .mapInArrow(draw, "tree int, cells binary, draws binary, sums binary"))
    grown = drawn.repartition(lanes, "tree").sortWithinPartitions("tree").mapInArrow(trees, "cell long, value double")
    return grown.groupBy("cell").agg((F.sum("value") / n_trees + F.lit(middle)).alias("prediction"))

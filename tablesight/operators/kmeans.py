"""k-means with several starts in the same passes over the rows (M8).

Starts differ in their random choices only, so each pass serves all of them: a
task keeps partial sums keyed by (start, centre) and sends a row per key and
dimension.  Starting centres come from k-means|| (Bahmani et al. 2012): two
rounds of sampling by squared distance gather a few candidates a start, their
weights are the rows nearest to them, and a weighted k-means++ on the driver
picks k of each start's candidates.  The number of passes depends on the slowest
start, not on how many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INIT_ROUNDS = 2
MAX_ITERATIONS = 20
TOLERANCE = 1e-4
SLICE = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of every row to every centre; never negative."""
    cross = x @ centers.T
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * cross + (centers * centers).sum(axis=1), 0.0)


def _slices(batches, column: int = 0):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield _matrix(batch.column(column).slice(at, SLICE))


def _sums(rows: DataFrame, vector: str, starts: list[np.ndarray], with_vectors: bool = True):
    """Per start: rows nearest to each centre, the sums of their vectors, and the
    cost.  One pass for all starts."""
    def run(batches):
        count = [np.zeros(len(c)) for c in starts]
        total = [np.zeros(c.shape) for c in starts]
        cost = np.zeros(len(starts))
        for x in _slices(batches):
            for s, centers in enumerate(starts):
                far = squared_distances(x, centers)
                to = far.argmin(axis=1)
                cost[s] += far[np.arange(len(x)), to].sum()
                count[s] += np.bincount(to, minlength=len(centers))
                if with_vectors:
                    total[s] += (to == np.arange(len(centers))[:, None]).astype(float) @ x
        out = []
        for s, centers in enumerate(starts):
            out.append((s, -1, -1, cost[s]))
            for c in np.flatnonzero(count[s]):
                out.append((s, int(c), -1, count[s][c]))
                if with_vectors:
                    out += [(s, int(c), d, v) for d, v in enumerate(total[s][c])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["s", "c", "d", "v"])

    # a row per start, centre and dimension reaches the driver
    parts = rows.select(vector).mapInArrow(run, "s int, c int, d int, v double")
    count = [np.zeros(len(c)) for c in starts]
    total = [np.zeros(c.shape) for c in starts]
    cost = np.zeros(len(starts))
    for s, c, d, v in parts.groupBy("s", "c", "d").agg(F.sum("v")).collect():
        if c < 0:
            cost[s] = v
        elif d < 0:
            count[s][c] = v
        else:
            total[s][c, d] = v
    return count, total, cost


def _sampled(rows: DataFrame, vector: str, starts: list[np.ndarray], cost: np.ndarray, wanted: float,
             seed: int, step: int) -> list[np.ndarray]:
    """Per start, distinct rows drawn with a chance of ``wanted`` times their share
    of the cost: about that many.  The draws follow from the seed and the place of a
    row in its task, so a repeated task draws the same."""
    def run(batches):
        rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        for x in _slices(batches):
            drawn_s, drawn_x = [], []
            for s, centers in enumerate(starts):
                near = squared_distances(x, centers).min(axis=1)
                hit = rng.random(len(x)) < (wanted * near / cost[s] if cost[s] > 0 else np.zeros(len(x)))
                drawn_s += [s] * int(hit.sum())
                drawn_x += x[hit].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(drawn_s, pa.int32()), pa.array(drawn_x, pa.list_(pa.float64()))], names=["s", "x"])

    drawn = rows.select(vector).mapInArrow(run, "s int, x array<double>").distinct().collect()
    return [np.concatenate([c, np.array(sorted(r["x"] for r in drawn if r["s"] == s)).reshape(-1, c.shape[1])])
            for s, c in enumerate(starts)]


def _weighted_plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted points, then a few rounds of Lloyd's on them."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared_distances(points, points[chosen]).min(axis=1)
    while len(chosen) < k:
        chance = weights * near
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
        near = np.minimum(near, squared_distances(points, points[chosen[-1:]])[:, 0])
    centers = points[chosen]
    for _ in range(30):
        to = squared_distances(points, centers).argmin(axis=1)
        moved = np.array([np.average(points[to == c], axis=0, weights=weights[to == c]) if weights[to == c].sum() > 0
                          else centers[c] for c in range(len(centers))])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def fit(rows: DataFrame, vector: str, k: int, n_init: int, seed: int) -> tuple[np.ndarray, float]:
    """(centres, cost) of the best of ``n_init`` starts over the array column
    ``vector``.  There are fewer than k centres where fewer distinct rows are."""
    hashed = F.xxhash64(F.lit(seed), vector)
    first = rows.select(vector).agg(*[F.min_by(vector, F.xxhash64(F.lit(s), hashed)).alias(f"s{s}") for s in range(n_init)]).first()
    if first[0] is None:
        raise ValueError("no rows to cluster")
    starts = [np.array([x], float) for x in first]
    for step in range(INIT_ROUNDS):
        _, _, cost = _sums(rows, vector, starts, with_vectors=False)
        starts = _sampled(rows, vector, starts, cost, 2.0 * k, seed, step)
    weights, _, _ = _sums(rows, vector, starts, with_vectors=False)
    rng = np.random.default_rng(seed)
    starts = [_weighted_plus_plus(c, np.maximum(w, 0.0), k, rng) for c, w in zip(starts, weights)]
    moving = set(range(n_init))
    for _ in range(MAX_ITERATIONS):
        active = sorted(moving)
        count, total, _ = _sums(rows, vector, [starts[s] for s in active])
        for s, n, t in zip(active, count, total):
            new = np.where(n[:, None] > 0, t / np.maximum(n, 1)[:, None], starts[s])
            if ((new - starts[s]) ** 2).sum(axis=1).max() <= TOLERANCE ** 2:
                moving.discard(s)
            starts[s] = new
        if not moving:
            break
    _, _, cost = _sums(rows, vector, starts, with_vectors=False)
    best = int(cost.argmin())
    return starts[best], float(cost[best])


def nearest(centers: np.ndarray):
    """A function of an array column: the number of the nearest centre."""
    @F.pandas_udf("int")
    def cluster_of(vectors):
        import pandas as pd
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, centers.shape[1]))
        return pd.Series(squared_distances(x, centers).argmin(axis=1).astype(np.int32))

    return cluster_of

"""Centroid clustering over a vector approximation file (operator 12).

Vectors of integers are compressed to ``CELL_BITS`` bits a dimension: each
dimension is cut into 2^CELL_BITS cells at marks taken from its distribution, and a
vector's approximation is its cell numbers, packed.  For a set of centroids,
two lookup tables (dimension, cell, centroid) hold the least and the greatest
squared difference a member of the cell can have from the centroid; summed over
the dimensions they give every centroid's distance interval of a vector, exact
in integers.  Centroids whose interval starts above the least interval end are
out.  Where one is left, it is the nearest; only where intervals still overlap
are the full vectors taken and the distances of the remaining centroids computed.

The approximations and the vectors are two columns of one written table, so that
neither a lookup nor a fetch shuffles anything: an assignment scans it once, in
Arrow batches, and takes vectors out of the batch row by row.  New centroids need
the sum of every member's vector; tasks add those up and send one row a cluster.
The marks decide how many vectors are fetched, never what comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.session import scratch_table

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
CELL_BITS = 6
#: Share of a dimension's values in each of its two end cells, about.
OUTER = 0.001
#: Largest magnitude of a component: 64 squared differences of twice this fit a long.
LIMIT = 1 << 27
#: Vectors handled at once inside a task.
SLICE = 2048


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their vectors as integers floor(scale * x)) of a list column.

    Kept are lists of ``dims`` numbers, none null or not finite; components beyond
    +-LIMIT are taken as +-LIMIT."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1)
    right = np.flatnonzero(np.asarray(sizes) == dims)
    flat = pa.compute.list_flatten(vectors.take(pa.array(right)))
    values = np.asarray(pa.compute.fill_null(flat, float("nan")), dtype=np.float64).reshape(-1, dims)
    fine = np.isfinite(values).all(axis=1)
    whole = np.floor(np.clip(scale * values[fine], -LIMIT, LIMIT)).astype(np.int64)
    return right[fine], whole


def pack(cells: np.ndarray, bits: int) -> pa.Array:
    """One binary of dims * bits bits for every row of cell numbers."""
    spread = (cells[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    raw = np.packbits(spread.reshape(len(cells), -1), axis=1)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def unpack(packed: pa.Array, dims: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    spread = np.unpackbits(raw, axis=1)[:, :dims * bits].reshape(-1, dims, bits)
    return spread @ (1 << np.arange(bits)).astype(np.uint8)


def interval_tables(marks: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared difference by (dimension, cell, centroid).

    ``marks`` holds, for each dimension, the first value of every cell and, last,
    one more than the dimension's maximum."""
    low, high = marks[:, :-1, None], np.maximum(marks[:, 1:, None] - 1, marks[:, :-1, None])
    at = centroids.T[:, None, :]
    to_low, to_high = (at - low) ** 2, (at - high) ** 2
    inside = (at >= low) & (at <= high)
    return np.where(inside, 0, np.minimum(to_low, to_high)), np.maximum(to_low, to_high)


def cell_numbers(vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape, np.uint8)
    for d in range(vectors.shape[1]):
        out[:, d] = np.searchsorted(marks[d, 1:-1], vectors[:, d], side="right")
    return out


def nearest(cells: np.ndarray, fetch, tables, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, candidates left by the intervals) of every row; ``fetch(rows)``
    gives the full vectors of some of them.  Ties go to the smaller number."""
    low = np.zeros((len(cells), len(centroids)), np.int64)
    high = np.zeros_like(low)
    for d in range(cells.shape[1]):
        low += tables[0][d][cells[:, d]]
        high += tables[1][d][cells[:, d]]
    possible = low <= high.min(axis=1, keepdims=True)
    candidates = possible.sum(axis=1)
    cluster = possible.argmax(axis=1)
    open_rows = np.flatnonzero(candidates > 1)
    if len(open_rows):
        vectors = fetch(open_rows)
        row, c = np.nonzero(possible[open_rows])
        distance = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
        distance[row, c] = ((vectors[row] - centroids[c]) ** 2).sum(axis=1)
        cluster[open_rows] = distance.argmin(axis=1)
    return cluster, candidates


def assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, tables, dims: int, bits: int):
    """(batch slice, clusters, candidates, function fetching vectors) of the rows
    of a vector file."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            column = part.column("__vector")
            values = np.asarray(column.values)
            first = np.asarray(column.offsets)[:-1]

            def fetch(rows, values=values, first=first):
                return values[first[rows][:, None] + np.arange(dims)].astype(np.int64)

            cluster, candidates = nearest(unpack(part.column("__cells"), dims, bits), fetch, tables, centroids)
            yield part, cluster, candidates, fetch


class VectorFile:
    """The approximation file of one table: ``rows`` (the kept columns, ``__cells``
    packed, ``__vector`` integers), and the marks of the cells."""

    def __init__(self, df: DataFrame, vector_col: str, keep: list[str], dims: int = DIMENSIONS,
                 scale: int = SCALE, bits: int = CELL_BITS):
        if not 1 <= bits <= 8:
            raise ValueError("cells take 1 to 8 bits")
        self.dims, self.bits, self.spark = dims, bits, df.sparkSession
        source = df.select(*[df[c] for c in keep], df[vector_col].cast("array<double>").alias("__source"))
        self.marks = self._marks(source, scale)
        self.rows = None if self.marks is None else scratch_table(self._packed(source, keep, scale), "vectors")

    def _marks(self, source: DataFrame, scale: int) -> np.ndarray | None:
        """First values of each dimension's cells.  Inner cells are equally wide
        between two outer quantiles (medians of those of the batches), so a few
        outliers widen the two end cells only, which reach to the extremes."""
        dims, cells = self.dims, 1 << self.bits

        def run(batches):
            for batch in batches:
                _, whole = integers(batch.column("__source"), dims, scale)
                if len(whole):
                    ends = np.quantile(whole, [0, OUTER, 1 - OUTER, 1], axis=0).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(dims), pa.int32()), *map(pa.array, ends)],
                        names=["d", "least", "low", "high", "most"])

        ends = source.select("__source").mapInArrow(run, "d int, least long, low long, high long, most long")
        stats = ends.groupBy("d").agg(
            F.min("least"), F.percentile_approx("low", 0.5), F.percentile_approx("high", 0.5), F.max("most")).collect()
        if not stats:
            return None
        marks = np.empty((dims, cells + 1), np.int64)
        for d, least, low, high, most in stats:  # one row a dimension
            inner = np.floor(np.linspace(low, high + 1, cells - 1)).astype(np.int64)
            marks[d] = [least, *np.clip(inner, least, most + 1), most + 1]
        return marks

    def _packed(self, source: DataFrame, keep: list[str], scale: int) -> DataFrame:
        dims, bits, marks = self.dims, self.bits, self.marks

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    kept, whole = integers(part.column("__source"), dims, scale)
                    chosen = part.take(pa.array(kept))
                    vectors = pa.ListArray.from_arrays(
                        np.arange(len(whole) + 1, dtype=np.int32) * dims, pa.array(whole.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [*[chosen.column(c) for c in keep], pack(cell_numbers(whole, marks), bits), vectors],
                        names=[*keep, "__cells", "__vector"])

        kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
        return source.mapInArrow(run, f"{kept}, __cells binary, __vector array<int>")

    def means(self, centroids: np.ndarray) -> np.ndarray:
        """Centroids after one round: exact floor of sum / count of the members,
        componentwise; a centroid without members stays."""
        dims, bits, tables = self.dims, self.bits, interval_tables(self.marks, centroids)

        def run(batches):
            sums = np.zeros((len(centroids), dims), np.int64)
            counts = np.zeros(len(centroids), np.int64)
            for part, cluster, _, fetch in assignments(batches, centroids, tables, dims, bits):
                member = (cluster == np.arange(len(centroids))[:, None]).astype(np.int64)
                sums += member @ fetch(np.arange(part.num_rows))
                counts += member.sum(axis=1)
            c, d = np.nonzero(np.repeat(counts[:, None], dims, axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(counts[c]), pa.array(sums[c, d])],
                names=["c", "d", "n", "total"])

        parts = self.rows.select("__cells", "__vector").mapInArrow(run, "c int, d int, n long, total long")
        totals = parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s"))
        out = centroids.copy()
        for r in totals.collect():  # one row a cluster and dimension
            out[r["c"], r["d"]] = int(r["s"]) // r["n"]
        return out

    def assigned(self, centroids: np.ndarray, keep: list[str]) -> DataFrame:
        """The kept columns, ``cluster``, squared ``distance``, and how many
        centroids the intervals left (``candidates``)."""
        dims, bits, tables = self.dims, self.bits, interval_tables(self.marks, centroids)
        source = self.rows.select(*keep, "__cells", "__vector")

        def run(batches):
            for part, cluster, candidates, fetch in assignments(batches, centroids, tables, dims, bits):
                distance = ((fetch(np.arange(part.num_rows)) - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(cluster, pa.int32()), pa.array(distance),
                     pa.array(candidates, pa.int32())], names=[*keep, "cluster", "distance", "candidates"])

        kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
        return source.mapInArrow(run, f"{kept}, cluster int, distance long, candidates int")


def first_centroids(file: VectorFile, id_col: str, n: int) -> np.ndarray:
    """Vectors of the ``n`` smallest SHA-256 hashes of ``1:<id>``; null ids last,
    equal hashes by the vectors."""
    order = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    best = file.rows.orderBy(order.asc_nulls_last(), "__vector").select("__vector").limit(n).collect()
    return np.array([r[0] for r in best], np.int64).reshape(len(best), file.dims)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
                    rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE,
                    bits: int = CELL_BITS) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, candidates.

    Kept are vectors of exactly ``dims`` components, none null or not finite; the
    others give no row.  Components are floor(scale * x), those beyond +-LIMIT taken
    as +-LIMIT.  Repeated rows and equal vectors come back each; a null id starts no
    centroid while others can, and comes back null.  With fewer vectors than
    clusters there are as many centroids as vectors; without any, the result is
    empty.  Sums beyond a long are its maximum.  Other columns are not read.
    """
    schema = (f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, cluster int, distance long, "
              "cluster_inertia long, inertia long, centroid_sha256 string, candidates int")
    file = VectorFile(df, vector_col, [id_col], dims, scale, bits)
    if file.rows is None:
        return df.sparkSession.createDataFrame([], schema)
    centroids = first_centroids(file, id_col, clusters)
    for _ in range(rounds):
        centroids = file.means(centroids)
    members = scratch_table(file.assigned(centroids, [id_col]), "members")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")

    def inertia(total):
        return F.least(total, most).cast("long")

    by_cluster = {r["cluster"]: r["total"] for r in members.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(by_cluster.values())
    known = df.sparkSession.createDataFrame(
        [(c, total, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, total in by_cluster.items()],
        "cluster int, own decimal(38,0), whole decimal(38,0), centroid_sha256 string")
    return members.join(F.broadcast(known), "cluster").select(
        id_col, "cluster", "distance", inertia(F.col("own")).alias("cluster_inertia"),
        inertia(F.col("whole")).alias("inertia"), "centroid_sha256", "candidates")

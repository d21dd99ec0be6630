"""Isolation-forest anomaly detection (M10), after Liu, Ting & Zhou (2008).

MLlib has no isolation forest, so the work is split the Spark way:

1. preprocessing as DataFrame expressions: winsorise to the 1 % / 99 %
   quantiles, median fill, standardise;
2. a hash sample of about ``1.2 * n_trees * max_samples`` rows, each row
   hashed to one tree (for small inputs each of its replicas separately); every
   tree group holds a bounded number of rows (~1.2 * max_samples), whatever the
   data size;
3. ``groupBy(tree).applyInPandas`` grows the trees in parallel;
4. the forest (at most ``n_trees * (2 * max_samples - 1)`` nodes) is collected,
   laid out as complete binary trees of one depth (the children of node i are
   2i + 1 and 2i + 2, leaves are repeated downwards) and broadcast; Arrow batches
   walk each level of a tree with three look-ups for all rows;
5. the threshold is the exact ``1 - contamination`` quantile of the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.frames import Frames, shared
from tablesight.functions.scalars import number_of
from tablesight.operators.profile import _q
from tablesight.operators.quantiles import exact_quantiles
from tablesight.session import scratch_table

EULER = 0.5772156649015329
ROWS_AT_ONCE = 4096


def avg_path(n: float) -> float:
    """c(n): average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree as flat arrays: feature, split, left, right, size
    (leaf when feature = -1)."""
    feat, split, left, right, size = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        i = len(feat)
        feat.append(-1), split.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
        if depth >= max_depth or len(rows) <= 1:
            return i
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return i
        q = int(rng.choice(cand))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        feat[i], split[i] = q, p
        li = node(rows[go_left], depth + 1)
        ri = node(rows[~go_left], depth + 1)
        left[i], right[i] = li, ri
        return i

    node(np.arange(len(x)), 0)
    return feat, split, left, right, size


def _prepare(df: DataFrame, columns: list[str], clip: tuple[float, float] | None) -> DataFrame:
    num = df.select("*", *[number_of(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])
    xs = [f"__x{i}" for i in range(len(columns))]
    probs = [0.5] + (list(clip) if clip else [])
    q = exact_quantiles(num.select(*xs), xs, probs)
    cols = []
    for x in xs:
        v = F.col(x)
        if clip and q[(x, clip[0])] is not None:
            v = F.least(F.greatest(v, F.lit(q[(x, clip[0])])), F.lit(q[(x, clip[1])]))
        cols.append(v.alias(x))
    clipped = num.select(*[F.col(_q(c)) for c in df.columns], *cols)
    # median of the clipped column = clip of the median (monotone map)
    med = {}
    for x in xs:
        m = q[(x, 0.5)]
        if clip and m is not None:
            m = min(max(m, q[(x, clip[0])]), q[(x, clip[1])])
        med[x] = m if m is not None else 0.0
    filled = clipped.select(*[F.col(_q(c)) for c in df.columns],
                            *[F.coalesce(F.col(x), F.lit(med[x])).alias(x) for x in xs])
    st = filled.agg(*[y for x in xs for y in (F.avg(x).alias(f"m{x}"), F.stddev_pop(x).alias(f"s{x}"))]).first()
    scaled = []
    for x in xs:
        m, s = st[f"m{x}"] or 0.0, st[f"s{x}"] or 0.0
        scaled.append(((F.col(x) - F.lit(m)) / F.lit(s if s > 0 else 1.0)).alias(x))
    return filled.select(*[F.col(_q(c)) for c in df.columns], *scaled)


def isolation_forest_scores(df: DataFrame, columns: list[str], key: list[str],
                            n_trees: int = 200, max_samples: int = 256, seed: int = 42,
                            clip: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """Every row of ``df`` with ``anomaly_score`` = s(x) in (0, 1]: larger is
    more anomalous."""
    spark = df.sparkSession
    # counted, sampled and scored: written once
    prep = scratch_table(_prepare(df, columns, clip), "prepared")
    xs = [f"__x{i}" for i in range(len(columns))]
    n = prep.count()
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    target = 1.2 * n_trees * psi
    frac = min(1.0, target / max(1, n))
    reps = int(min(n_trees, max(1, math.ceil(target / max(1.0, n * frac)))))
    # which rows are sampled, and to which trees, follows from the keys alone, so
    # neither partitioning nor a retry changes the forest
    h = F.xxhash64(F.lit(seed), *[F.col(_q(c)) for c in key])
    pool = prep.select(*xs, h.alias("_k"))
    if frac < 1.0:
        pool = pool.filter(F.pmod("_k", F.lit(1 << 30)) < F.lit(int(frac * (1 << 30))))
    pool = pool.select(*xs, "_k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_j"))
    pool = pool.select(*xs, F.xxhash64("_k", "_j").alias("_k"),
                       F.pmod(F.xxhash64(F.lit(seed + 1), "_k", "_j"), F.lit(n_trees)).cast("int").alias("tree"))

    node_schema = T.StructType([
        T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
        T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType())])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_k", *xs], kind="stable").head(psi)
        rng = np.random.default_rng(seed * 100003 + t)
        feat, split, left, right, size = _grow(pdf[xs].to_numpy(dtype=float), rng, max_depth)
        k = len(feat)
        return pd.DataFrame({"tree": np.full(k, t, dtype=np.int32), "node": np.arange(k, dtype=np.int32),
                             "feature": np.asarray(feat, dtype=np.int32), "split": np.asarray(split),
                             "left": np.asarray(left, dtype=np.int32), "right": np.asarray(right, dtype=np.int32),
                             "size": np.asarray(size, dtype=np.int32)})

    nodes = pool.groupBy("tree").applyInPandas(build, node_schema).toPandas()
    # forest size is bounded by n_trees * (2 * psi - 1) nodes, not by the data
    forest = [complete_tree(*(g.sort_values("node")[c].to_numpy() for c in ("feature", "split", "left", "right", "size")),
                            max_depth) for _, g in nodes.groupby("tree")]
    bc = spark.sparkContext.broadcast(forest)
    c_psi = avg_path(psi)

    out_fields = [f for f in prep.schema.fields if f.name not in xs]
    keep = [f.name for f in out_fields]
    out_schema = T.StructType(out_fields + [T.StructField("anomaly_score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in xs])
            mean_path = path_lengths(x, bc.value, max_depth) / max(1, len(bc.value))
            s = np.power(2.0, -mean_path / c_psi) if c_psi > 0 else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s)], names=[*keep, "anomaly_score"])

    return prep.select(*[F.col(_q(c)) for c in keep], *xs).mapInArrow(score, out_schema)


def complete_tree(feature, split, left, right, size, depth: int):
    """(features, splits, path lengths of the lowest level) of a tree made
    complete: a leaf's place is taken by a test that always goes left, down to the
    lowest level, where the leaf's own path length stands."""
    n = 2 ** (depth + 1) - 1
    features, splits, lengths = np.zeros(n, np.intp), np.full(n, np.inf), np.zeros(n)
    todo = [(0, 0, 0)]
    while todo:
        node, at, level = todo.pop()
        if feature[node] >= 0:
            features[at], splits[at] = feature[node], split[node]
            todo += [(left[node], 2 * at + 1, level + 1), (right[node], 2 * at + 2, level + 1)]
            continue
        length = level + avg_path(float(size[node]))
        for _ in range(level, depth):
            at = 2 * at + 1
        lengths[at] = length
    return features, splits, lengths


def path_lengths(x: np.ndarray, forest: list, depth: int) -> np.ndarray:
    """Sum of each row's path lengths over the trees.  All rows of a slice that
    stays in the processor's cache go down a tree together."""
    total = np.zeros(len(x))
    width = x.shape[1]
    for start in range(0, len(x), ROWS_AT_ONCE):
        part = np.ascontiguousarray(x[start:start + ROWS_AT_ONCE])
        flat, row = part.ravel(), np.arange(len(part)) * width
        sums = total[start:start + ROWS_AT_ONCE]
        for features, splits, lengths in forest:
            at = np.zeros(len(part), np.intp)
            for _ in range(depth):
                right = flat.take(row + features.take(at)) >= splits.take(at)
                at += at
                at += 1
                at += right
            sums += lengths.take(at)
    return total


# Column names that identify a row in a report.
REPORT_KEYS = ("ts", "timestamp", "time", "date", "datetime", "id", "symbol", "price", "value")


def report_keys(columns: list[str]) -> list[str]:
    """The columns named like identifiers, else the first three."""
    return [c for c in columns if c.lower() in REPORT_KEYS] or columns[:3]


def positions(df: DataFrame, key: list[str], found: list) -> list[int]:
    """How many rows of ``df`` come before each of the few ``found`` rows in
    key order.  Every row is put between two of the sorted found keys, in one
    pass; the driver gets one count per gap."""
    if not found:
        return []
    types = {c: df.schema[c].dataType for c in key}
    form = F.struct(*[F.col(_q(c)).alias(c) for c in key])
    ranks = df.sparkSession.createDataFrame(
        [(i, *[r[c] for c in key]) for i, r in enumerate(found)],
        T.StructType([T.StructField("i", T.IntegerType()), *[T.StructField(c, types[c]) for c in key]]))
    marks = ranks.agg(F.sort_array(F.collect_list(F.struct(form.alias("k"), "i"))).alias("marks"))   # one row
    upto = F.size(F.filter(F.transform("marks", lambda m: m["k"]), lambda k: k <= F.col("at")))
    gaps = (df.select(form.alias("at")).crossJoin(F.broadcast(marks)).groupBy(upto.alias("gap"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    counts = {r["gap"]: r["n"] for r in gaps}
    order = [m["i"] for m in marks.first()["marks"]]
    out = [0] * len(found)
    for place, i in enumerate(order):
        # rows in the gaps up to this mark are before it; equal keys lie at or after it
        out[i] = sum(counts.get(g, 0) for g in range(place + 1))
    return out


def anomaly(df: DataFrame, columns: list[str], key: list[str], contamination: float = 0.02,
            top: int = 50, n_trees: int = 200, max_samples: int = 256, seed: int = 42,
            min_rows: int = 50, clip: tuple[float, float] | None = (0.01, 0.99)) -> Frames:
    """``summary`` (anomaly_fraction, anomaly_count, threshold) and
    ``top`` (T2: the ``top`` highest-scoring anomalies with their position in
    key order, their key and identifying columns, and their score relative to
    the threshold, as the reference reports it), and all ``scores``.  The rows are
    scored when the first frame is asked for."""
    spark = df.sparkSession
    n = df.count()
    if not columns or n < min_rows:
        return Frames({"summary": lambda: spark.createDataFrame(
            [("skipped", "Need >=1 numeric cols and >=50 rows")], "status string, reason string")})
    shown = [c for c in report_keys(df.columns) if c not in key]
    held = list(dict.fromkeys([*key, *columns, *shown]))
    # the scores feed the threshold, the count and the top list: score once
    scores = shared(lambda: scratch_table(isolation_forest_scores(
        df.select(*held), columns, key, n_trees, max_samples, seed, clip), "anomaly"))
    limit: list[float] = []

    def threshold() -> float:
        if not limit:
            limit.append(exact_quantiles(scores().select("anomaly_score"), ["anomaly_score"], [1 - contamination])[
                ("anomaly_score", 1 - contamination)])
        return limit[0]

    def flagged() -> DataFrame:
        return scores().filter(F.col("anomaly_score") > F.lit(threshold()))

    def summary() -> DataFrame:
        return flagged().agg(F.count(F.lit(1)).alias("anomaly_count")).select(
            (F.col("anomaly_count") / F.lit(n)).alias("anomaly_fraction"), "anomaly_count",
            F.lit(threshold()).alias("threshold"))

    def top_rows() -> DataFrame:
        best = (flagged().select(*key, *shown, (F.col("anomaly_score") - F.lit(threshold())).alias("anomaly_score"))
                .orderBy(F.desc("anomaly_score"), *key).limit(top))
        found = best.collect()   # at most ``top`` rows
        schema = T.StructType([T.StructField("row_index", T.LongType()), *best.schema.fields])
        return spark.createDataFrame([(b, *r) for b, r in zip(positions(df, key, found), found)], schema)

    return Frames({"summary": summary, "top": top_rows, "scores": scores})

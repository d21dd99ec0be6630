import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import forest
from tablesight.operators import ml as M


def _rows(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x, c, d = rng.integers(1, 51, n), rng.integers(0, 7, n), rng.integers(0, 5, n)
    y = 3.0 * x + 40.0 * (c == 2) - 25.0 * (d == 1) * (x > 20) + rng.normal(scale=2.0, size=n)
    return [(i, int(a), f"c{b}", f"d{e}", float(t)) for i, (a, b, e, t) in enumerate(zip(x, c, d, y))]


SCHEMA = "id long, x int, c string, d string, y double"


def _plain(cells, codes, radices, numbers, w, s, depth):
    """One tree by plain loops, every slot tried."""
    if len([c for c in cells if w[c] > 0]) < 2 or depth == 0:
        kept = None
    else:
        total, weight = sum(s[c] for c in cells), sum(w[c] for c in cells)
        kept, top = None, total ** 2 / weight * (1 + 1e-12)
        for j, radix in enumerate(radices):
            for code in range(0 if j < numbers else 1, radix):
                left = [c for c in cells if (codes[j][c] <= code if j < numbers else codes[j][c] == code)]
                lw, ls = sum(w[c] for c in left), sum(s[c] for c in left)
                if 0 < lw < weight and ls ** 2 / lw + (total - ls) ** 2 / (weight - lw) > top + 1e-9:
                    kept, top = left, ls ** 2 / lw + (total - ls) ** 2 / (weight - lw)
    if kept is None:
        mean = sum(s[c] for c in cells) / max(1, sum(w[c] for c in cells))
        return {c: mean for c in cells}
    rest = [c for c in cells if c not in set(kept)]
    return {**_plain(kept, codes, radices, numbers, w, s, depth - 1), **_plain(rest, codes, radices, numbers, w, s, depth - 1)}


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_a_tree_is_the_plain_one(depth):
    rng = np.random.default_rng(depth)
    radices = [6, 4, 5]
    codes = np.array([rng.integers(0, r, 60) for r in radices])
    codes = np.unique(codes, axis=1)
    n = codes.shape[1]
    w = rng.poisson(1.5, n).astype(float)
    s = np.where(w > 0, w * rng.normal(size=n), 0.0)
    got = forest.grow(codes, radices, 1, w, s, rng, 1 + 3 + 4, depth)
    want = _plain(list(range(n)), codes.tolist(), radices, 1, w, s, depth)
    # equal splits of the drawn cells may send the others either way
    assert np.allclose(got[w > 0], [want[c] for c in range(n) if w[c] > 0])
    assert got.min() >= got[w > 0].min() and got.max() <= got[w > 0].max()


def test_each_node_tries_as_many_slots(monkeypatch):
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 7)
    chosen = forest._chosen(np.random.default_rng(0), 3000, 9, 3)
    assert (chosen.sum(axis=1) == 3).all() and abs(chosen.mean(axis=0) - 1 / 3).max() < 0.05


def test_rows_of_equal_bins_pass_no_tree_one_by_one(spark, monkeypatch):
    """MLlib takes every row past every tree at every level."""
    from pyspark.ml.regression import RandomForestRegressor

    def fit(*_):
        raise AssertionError("MLlib's forest")

    monkeypatch.setattr(RandomForestRegressor, "_fit", fit)
    pred = M.regress(spark.createDataFrame(_rows(), SCHEMA), "y", ["x"], ["c", "d"], ["id"], n_trees=40)
    m = M.regression_metrics(pred).first()
    assert m.n_test == 240 and m.r2 > 0.95


def test_forest_agrees_with_mllib(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), SCHEMA)
    ask = lambda: {r.id: r.prediction for r in M.regress(df, "y", ["x"], ["c", "d"], ["id"], n_trees=100).collect()}
    cells = ask()
    monkeypatch.setattr(forest, "CELLS", 10)   # too many cells: MLlib
    rows = ask()
    assert cells.keys() == rows.keys()
    a, b = (np.array([p[i] for i in sorted(p)]) for p in (cells, rows))
    assert np.corrcoef(a, b)[0, 1] > 0.99 and abs(a - b).mean() < 0.1 * b.std()


def test_forest_keeps_repeated_null_and_unknown_rows(spark, monkeypatch):
    """Null and repeated keys, null targets, null features; the same forest on any
    partitioning and with draws in many tasks."""
    rows = [(i if i % 9 else None, x if i % 11 else None, c if i % 13 else None, d, y if i % 17 else None) for i, x, c, d, y in _rows(600)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA)
    ask = lambda df: sorted((r.id or -1, r.label, round(r.prediction, 6)) for r in M.regress(
        df, "y", ["x"], ["c", "d"], ["id"], n_trees=12).collect())
    split = M.hash_split(df.withColumn("__y", F.col("y")), ["id"])
    one = ask(df)
    assert len(one) == split.filter("split = 'test' AND y IS NOT NULL").count() > 100
    monkeypatch.setattr(forest, "GROUPS_AT_ONCE", 50)
    assert ask(df.repartition(5)) == one


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.lit(1.0).alias("k"))
    a, b, k = forest.thresholds(df, ["a", "b", "k"])
    assert a == [0.5, 1.5] and k == [] and len(b) == 31 and abs(b[15] - 499.5) < 1

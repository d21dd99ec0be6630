"""Statistical learning on Spark ML.

Features are built with DataFrame expressions (exact medians, mean/std
scaling, top-49 + "other" one-hot) and ``VectorAssembler``; models are
``pyspark.ml`` estimators, so fitting is distributed.  Metrics are plain
grouped aggregates over the prediction frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesight.functions.scalars import number_of
from tablesight.operators import forest, kmeans
from tablesight.operators.profile import _q
from tablesight.operators.ordered import row_position
from tablesight.operators.quantiles import exact_quantiles
from tablesight.operators.topk import key_hash
from tablesight.session import scratch_table


@dataclass(frozen=True)
class FeatureModel:
    """M1 fitted on some rows (the training part), applied to any."""
    numeric: list[str]
    categorical: list[str]
    median: dict[str, float | None]
    mean: dict[str, float]
    std: dict[str, float]
    categories: dict[str, list[str]]
    mode: dict[str, str | None]
    max_categories: int

    def coded(self, df: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], list[tuple[str, int]]]:
        """``keep`` columns, the scaled numbers ``num_i`` and the slots ``cat_i`` (-1:
        none), with the numbers' names and each category's name and slots."""
        parts = [((F.coalesce(number_of(df, c), F.lit(self.median[c]).cast("double")) - F.lit(self.mean[c]))
                  / F.lit(self.std[c])).alias(f"num_{i}") for i, c in enumerate(self.numeric)]
        hot = []
        for i, c in enumerate(self.categorical):
            values = self.categories[c]
            v = F.coalesce(F.col(_q(c)).cast("string"), F.lit(self.mode[c]))
            rest = len(values) if len(values) == self.max_categories - 1 else -1
            at = F.array_position(F.array(*[F.lit(x) for x in values]), v) - 1 if values else F.lit(-1)
            hot.append((F.when(at >= 0, at).otherwise(F.lit(rest)).alias(f"cat_{i}"), len(values) + (rest >= 0)))
        d = df.select(*[F.col(_q(k)) for k in keep], *parts, *[c for c, _ in hot])
        return d, [f"num_{i}" for i in range(len(parts))], [(f"cat_{i}", size) for i, (_, size) in enumerate(hot)]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns and the ``features`` vector."""
        keep = keep or []
        d, numbers, slots = self.coded(df, keep)
        # rarer values share one slot; values unknown to a short list have none
        vectors = [_one_hot(F.col(c), size) for c, size in slots if size]
        flat = F.concat(F.array(*[F.col(c) for c in numbers]).cast("array<double>"), *vectors)
        return d.select(*[F.col(_q(k)) for k in keep], array_to_vector(flat).alias("features"))


def _one_hot(at: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == at).cast("double"))


def fit_features(df: DataFrame, numeric: list[str], categorical: list[str], max_categories: int = 50) -> FeatureModel:
    """M1: numeric -> median fill -> (x - mean) / std (population std, 1 when
    0); categorical -> most frequent fill -> one-hot of the ``max_categories - 1``
    most frequent values (ties by value) plus one slot for the others."""
    num = df.select(*[number_of(df, c).alias(c) for c in numeric])
    med = exact_quantiles(num, numeric, [0.5]) if numeric else {}
    median = {c: med[(c, 0.5)] for c in numeric}
    filled = [F.coalesce(F.col(_q(c)), F.lit(median[c]).cast("double")) for c in numeric]
    st = num.agg(*[x for i, v in enumerate(filled) for x in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]
                 ).first() if numeric else {}
    mean = {c: st[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
    std = {c: st[f"s{i}"] if (st[f"s{i}"] or 0.0) > 0 else 1.0 for i, c in enumerate(numeric)}
    median = {c: 0.0 if m is None else m for c, m in median.items()}
    categories: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        stack = F.array(*[F.struct(F.lit(i).alias("i"), F.col(_q(c)).cast("string").alias("value"))
                          for i, c in enumerate(categorical)])
        counts = (df.select(F.inline(stack)).filter(F.col("value").isNotNull())
                  .groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")))
        w = W.partitionBy("i").orderBy(F.desc("n"), "value")
        # at most max_categories rows per column reach the driver
        top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_categories).collect()
        for r in sorted(top, key=lambda r: r["r"]):
            categories[categorical[r["i"]]].append(r["value"])
    mode = {c: v[0] if v else None for c, v in categories.items()}
    categories = {c: v[:max_categories - 1] if len(v) == max_categories else v for c, v in categories.items()}
    return FeatureModel(numeric, categorical, median, mean, std, categories, mode, max_categories)


def feature_pipeline(df: DataFrame, numeric: list[str], categorical: list[str],
                     keep: list[str] | None = None, max_categories: int = 50) -> DataFrame:
    """M1 fitted on and applied to the same rows, written once for the passes
    that follow."""
    return scratch_table(fit_features(df, numeric, categorical, max_categories).transform(df, keep), "features")


def hash_split(df: DataFrame, key: list[str], test_fraction: float = 0.2, seed: int = 42,
               stratify: str | None = None) -> DataFrame:
    """M2: ``split`` = 'test' or 'train' by the order of the key hash (see
    ``topk.key_hash``), within each class of ``stratify`` where given.

    A class's rows up to its ``round(test_fraction * rows)``-th hash are test
    rows.  Rows are counted per class and hash, so no class is sorted in one
    task: a threshold per class and slice of hashes finds the cut."""
    label = (F.col(_q(stratify)).cast("string") if stratify else F.lit("")).alias("__class")
    hashed = df.withColumn("__class", label).withColumn("__hash", key_hash(key, seed))
    slot = F.shiftright("__hash", 20)
    counts = hashed.groupBy("__class", slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy("__class").orderBy("__slot").rowsBetween(W.unboundedPreceding, 0)   # at most 4096 rows a class
    total = W.partitionBy("__class")
    cut = (counts.withColumn("__want", F.round(F.sum("__n").over(total) * test_fraction).cast("long"))
           .withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))
           .filter((F.col("__before") <= F.col("__want")) & (F.col("__want") < F.col("__before") + F.col("__n")))
           .select(F.col("__class").alias("__of"), "__slot", (F.col("__want") - F.col("__before")).alias("__more")))
    # inside the slot of the cut (a 4096th of the class), rows by hash and key
    here = F.struct("__hash", *[F.col(_q(k)) for k in key])
    inside = (hashed.join(cut, F.col("__class").eqNullSafe(F.col("__of")) & (slot == F.col("__slot")))
              .select("__class", "__more", here.alias("__at")))
    rank = F.row_number().over(W.partitionBy("__class").orderBy("__at"))
    edge = (inside.withColumn("__r", rank).filter(F.col("__r") == F.col("__more") + 1)
            .select(F.col("__class").alias("__of"), F.col("__at").alias("__edge")))
    return (hashed.join(edge, F.col("__class").eqNullSafe(F.col("__of")), "left")
            .withColumn("split", F.when(F.col("__edge").isNull() | (here < F.col("__edge")), "test").otherwise("train"))
            .drop("__class", "__hash", "__of", "__edge"))


def gate(task: str, ok: bool, reason: str):
    """One status row for a task that may be skipped."""
    return (task, "ok" if ok else "skipped", None if ok else reason)


def classify(df: DataFrame, target: str, numeric: list[str], categorical: list[str],
             key: list[str], model: str = "random_forest", seed: int = 42,
             n_trees: int = 250, max_depth: int = 30, test_fraction: float = 0.2,
             max_categories: int = 50) -> DataFrame:
    """M3: split (stratified), fit features and model on the train part, predict
    the test part.  Labels are the target's values as text; returns the keys,
    ``label`` and ``prediction``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    base = df.filter(F.col(_q(target)).isNotNull())
    split = scratch_table(hash_split(base, key, test_fraction, seed, target), "split")
    train, test = (split.filter(F.col("split") == part) for part in ("train", "test"))
    # class numbers come from a table of the classes, joined to the rows
    names = split.select(F.col(_q(target)).cast("string").alias("label")).distinct()
    classes = scratch_table(row_position(names, ["label"], "__y").withColumn("__y", F.col("__y").cast("double")), "classes")
    feats = fit_features(train, numeric, categorical, max_categories)

    def labelled(part: DataFrame) -> DataFrame:
        named = feats.transform(part.withColumn("label", F.col(_q(target)).cast("string")), [*key, "label"])
        return named.join(classes, "label")

    if model == "logreg":
        est = LogisticRegression(featuresCol="features", labelCol="__y", maxIter=2000)
    else:
        est = RandomForestClassifier(featuresCol="features", labelCol="__y", numTrees=n_trees,
                                     maxDepth=max_depth, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True)
    fitted = est.fit(scratch_table(labelled(train), "train"))
    pred = fitted.transform(labelled(test)).select(*key, "label", F.col("prediction").alias("__p"))
    back = classes.select(F.col("label").alias("prediction"), F.col("__y").alias("__p"))
    return pred.join(back, "__p", "left").select(*key, "label", "prediction")


def classification_metrics(pred: DataFrame, target: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """M4: accuracy, precision, recall, F1, n_test, and the sentence that says
    them; zero division -> 0.  ``target`` (one column: the whole target) decides
    the averaging, adds n_train and the class list: two classes are scored for
    the last in sort order, more are weighted by support."""
    pred = pred.select(F.col("label").cast("string").alias("label"), F.col("prediction").cast("string").alias("prediction"))
    cm = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cm.select(F.inline(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    per = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    per = (per.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)))
              .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
              .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(0.0)))
    three = ("precision", "recall", "f1")
    one = per.agg(F.sum("support").alias("n_test"), F.sum("tp").alias("tp"), F.sort_array(F.collect_set("c")).alias("seen"),
                  F.max_by(F.struct(*three), "c").alias("last"),
                  *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in three],
                  F.map_from_entries(F.collect_list(F.struct("c", F.struct(*three)))).alias("by"))
    if target is not None:
        t = target.select(F.col(target.columns[0]).cast("string").alias("c")).filter(F.col("c").isNotNull())
        whole = t.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(
            F.sum("n").alias("rows"), F.sort_array(F.collect_set("c")).alias("classes"))
        one = one.crossJoin(F.broadcast(whole))   # one row
    else:
        one = one.withColumn("classes", F.col("seen")).withColumn("rows", F.lit(None).cast("long"))
    binary, positive = F.size("classes") == 2, F.try_element_at("by", F.element_at("classes", -1))
    out = one.select(
        F.try_divide("tp", "n_test").alias("accuracy"),
        *[F.when(binary, F.coalesce(positive[m], F.lit(0.0))).otherwise(F.col(f"w_{m}")).alias(m) for m in three],
        (F.col("rows") - F.col("n_test")).alias("n_train"), F.col("n_test").cast("long").alias("n_test"),
        F.array_join("classes", ",").alias("classes"), F.lit(model).alias("model"))
    # The sentence of the classification report.
    return out.withColumn("plain_english", F.format_string(
        "The classifier achieved accuracy=%.3f and F1=%.3f. "
        "Accuracy is overall correctness, while F1 balances false alarms vs missed detections.",
        F.coalesce("accuracy", F.lit(0.0)), F.coalesce("f1", F.lit(0.0))))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """M5: counts of label x prediction in long form (a pivot of this is the
    matrix)."""
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def regress(df: DataFrame, target: str, numeric: list[str], categorical: list[str], key: list[str],
            model: str = "random_forest", alpha: float = 1.0, seed: int = 42,
            n_trees: int = 250, max_depth: int = 30, test_fraction: float = 0.2,
            max_categories: int = 50) -> DataFrame:
    """M6: split, fit features on the train part, drop rows without a numeric
    target, fit a random forest or ridge (alpha as in ``||y - Xw||^2 + alpha
    ||w||^2``), predict the test part.  Returns keys, ``label``, ``prediction``.

    The forest is grown from cells of equal bins (see ``forest``) where the columns
    make no more than ``forest.CELLS`` of them, else by MLlib."""
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    base = df.withColumn("__y", number_of(df, target))
    split = scratch_table(hash_split(base, key, test_fraction, seed), "split")
    train, test = (split.filter(F.col("split") == part) for part in ("train", "test"))
    feats = fit_features(train, numeric, categorical, max_categories)
    if model != "ridge":
        pred = _forest_of_cells(feats, train, test, key, n_trees, max_depth, seed)
        if pred is not None:
            return pred
    rows, asked = (feats.transform(part, [*key, "__y"]).filter(F.col("__y").isNotNull()) for part in (train, test))
    rows = scratch_table(rows, "train")
    if model == "ridge":
        st = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__y").alias("sd")).first()
        reg = alpha * (st["sd"] or 1.0) / max(1, st["n"])
        est = LinearRegression(featuresCol="features", labelCol="__y", regParam=reg, elasticNetParam=0.0,
                               standardization=False, solver="normal")
    else:
        est = RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=n_trees,
                                    maxDepth=max_depth, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True)
    pred = est.fit(rows).transform(asked)
    return pred.select(*key, F.col("__y").alias("label"), F.col("prediction").cast("double"))


def _forest_of_cells(feats: FeatureModel, train: DataFrame, test: DataFrame, key: list[str],
                     n_trees: int, max_depth: int, seed: int) -> DataFrame | None:
    """The test rows' keys, labels and predictions, or None for too many cells."""
    (rows, numbers, slots), (asked, _, _) = (feats.coded(part.filter(F.col("__y").isNotNull()), [*key, "__y"])
                                             for part in (train, test))
    cuts = forest.thresholds(rows, numbers)
    cell, radices = forest.cell_of(numbers, cuts, slots)
    if math.prod(radices) >= 1 << 62:
        return None
    asked = asked.select(*[F.col(_q(k)) for k in key], F.col("__y").alias("label"), cell.alias("__cell"))
    groups = forest.cell_groups(rows.select(cell.alias("cell"), F.col("__y").alias("y")), asked.select(F.col("__cell").alias("cell")))
    if groups.select("cell").distinct().count() > forest.CELLS:
        return None
    found = forest.predictions(groups, radices, len(numbers), n_trees, max_depth, seed)
    # at most CELLS rows
    found = F.broadcast(scratch_table(found, "forest").withColumnRenamed("cell", "__cell"))
    return asked.join(found, "__cell").select(*[F.col(_q(k)) for k in key], "label", "prediction")


def regression_metrics(pred: DataFrame, n_rows: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """M7: MAE, RMSE, R^2, the test row count and the sentence that says them;
    ``n_rows`` (one row, one column: rows with a target) adds n_train."""
    e = F.col("label") - F.col("prediction")
    one = pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                   (1 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))).alias("r2"),
                   F.count(F.lit(1)).alias("n_test"))
    if n_rows is not None:
        one = one.crossJoin(F.broadcast(n_rows.toDF("rows"))).withColumn("n_train", F.col("rows") - F.col("n_test")).drop("rows")
    # The sentence of the regression report.
    return one.withColumn("model", F.lit(model)).withColumn("plain_english", F.format_string(
        "The regression model has MAE=%.3f and RMSE=%.3f (lower is better). "
        "R²=%.3f measures how much variance is explained (closer to 1 is better).",
        *[F.coalesce(F.col(c), F.lit(0.0)) for c in ("mae", "rmse", "r2")]))


def cluster(feats: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42,
            features: str = "features") -> tuple[DataFrame, float]:
    """M8: k-means (k-means||) with ``n_init`` starts, keeping the one of lowest
    cost.  All starts share every pass over the rows (see ``kmeans``).  Returns
    rows with ``cluster`` and the cost."""
    rows = feats.withColumn("__v", vector_to_array(features))
    centers, cost = kmeans.fit(rows.select("__v"), "__v", k, n_init, seed)
    return rows.withColumn("cluster", kmeans.nearest(centers)("__v")).drop("__v"), cost


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def pca_project(feats: DataFrame, k: int = 2, keep: list[str] | None = None,
                features: str = "features") -> DataFrame:
    """M9: projection on the first k principal components of the centred
    features."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features,
                             outputCol="_c").fit(feats).transform(feats)
    proj = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    arr = vector_to_array("_p")
    return proj.select(*(keep or []), *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def vectors_from_array(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))

"""Task runner (U5, M13): descriptive, anomaly, clustering, classification,
regression and text tasks over one table, each gated by its preconditions.

Returns a dict of DataFrames plus a ``status`` frame (task, status, reason);
a task whose preconditions fail is reported as skipped, never raised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.functions.naming import SANITIZED, clean_names
from tablesight.functions.scalars import number_of
from tablesight.operators import anomaly as A
from tablesight.operators import clean as C
from tablesight.operators import ml as M
from tablesight.operators import profile as P
from tablesight.operators import text as X
from tablesight.operators.infer import infer_schema, types_dict
from tablesight.session import scratch_table

ALL_TASKS = ("descriptive", "anomaly", "clustering", "classification", "regression", "text")


@dataclass(frozen=True)
class Tunables:
    """Run knobs; frozen, so one run cannot change another's defaults."""
    kmeans_k: int = 5
    kmeans_restarts: int = 10
    pca_components: int = 2
    contamination: float = 0.02
    anomaly_trees: int = 200
    rf_trees: int = 250
    rf_max_depth: int = 30
    classification_model: str = "random_forest"
    regression_model: str = "random_forest"
    ridge_alpha: float = 1.0
    max_onehot_categories: int = 50
    random_state: int = 42
    test_fraction: float = 0.2
    clip_quantiles: tuple[float, float] | None = (0.01, 0.99)
    max_category_values: int = 200
    keyword_features: int | None = None
    keywords: int = 25
    summary_sentences: int = 8
    missing_shown: int = 25
    anomalies_shown: int = 50
    tasks: tuple[str, ...] = field(default=ALL_TASKS)


def prepare(df: DataFrame) -> DataFrame:
    """The table as the tasks see it: sanitised names, parsed dates and epochs,
    no constant columns."""
    return C.drop_constant_columns(C.parse_epoch(C.parse_datetimes(C.sanitize_columns(df))))


def feature_columns(df: DataFrame, without: list[str], knobs: Tunables) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by inferred type (I2), ids, dates and
    text left out, categories of too many values dropped (P12)."""
    d = df.drop(*without)
    if not d.columns:
        return [], []
    kinds = types_dict(infer_schema(d, unique_id_rule=False, bool_as_categorical=True, wide_time_names=True,
                                    fine_epoch=False, max_onehot_categories=knobs.max_onehot_categories))
    ids = set(kinds.get("id", []))
    cats = [c for c in kinds.get("categorical", []) if c not in ids]
    kept = set(C.drop_high_cardinality(d, cats, knobs.max_category_values).columns)
    return [c for c in kinds.get("numeric", []) if c not in ids], [c for c in cats if c in kept]


def run_tasks(df: DataFrame, key: list[str], classification_target: str | None = None,
              regression_target: str | None = None, text_col: str | None = None, tasks=None,
              knobs: Tunables = Tunables()) -> dict[str, DataFrame]:
    """Run the named tasks.  ``key`` names the columns that tell rows apart; all
    names are those of ``df`` and are sanitised with it."""
    tasks = tuple(tasks or knobs.tasks)
    if "all" in tasks:
        tasks = ALL_TASKS
    spark = df.sparkSession
    named = dict(zip(df.columns, clean_names(df.columns, SANITIZED)))
    key = [named[k] for k in key]
    classification_target, regression_target, text_col = (
        named.get(c, c) if c else None for c in (classification_target, regression_target, text_col))
    df = prepare(df)
    n = df.count()
    held = [c for c in key if c in df.columns]
    out: dict[str, DataFrame] = {}
    status = []

    def features(*targets: str | None) -> tuple[list[str], list[str]]:
        return feature_columns(df, list(dict.fromkeys([*held, *[t for t in targets if t]])), knobs)

    if "descriptive" in tasks:
        out["describe"] = P.describe_numeric(df)
        out["missing"] = P.missing_rate(df, top=knobs.missing_shown)
        out["top_values"] = P.top_values(df, [c for c in df.columns if c not in P.columns_of_type(df, "numeric")])
        status.append(M.gate("descriptive", True, ""))
    if "anomaly" in tasks:
        nums = features()[0]
        ok = bool(nums) and n >= 50
        status.append(M.gate("anomaly", ok, "Need >=1 numeric cols and >=50 rows"))
        if ok:
            res = A.anomaly(df, nums, held, knobs.contamination, knobs.anomalies_shown, knobs.anomaly_trees,
                            seed=knobs.random_state, clip=knobs.clip_quantiles)
            out["anomaly_summary"], out["anomaly_top"] = res["summary"], res["top"]
    if "clustering" in tasks:
        nums, cats = features()
        ok = bool(nums or cats) and n >= knobs.kmeans_k
        status.append(M.gate("clustering", ok, "Need feature columns and at least k rows"))
        if ok:
            feats = M.feature_pipeline(df, nums, cats, held, knobs.max_onehot_categories)
            assigned, _ = M.cluster(feats, knobs.kmeans_k, knobs.kmeans_restarts, knobs.random_state)
            out["cluster_sizes"] = M.cluster_sizes(assigned)
            out["pca"] = M.pca_project(feats, knobs.pca_components, keep=held)
    for task, target in (("classification", classification_target), ("regression", regression_target)):
        if task not in tasks:
            continue
        reason = _supervised_gate(df, task, target)
        status.append(M.gate(task, reason is None, reason or ""))
        if reason is not None:
            continue
        nums, cats = features(target)
        if task == "classification":
            pred = scratch_table(M.classify(
                df, target, nums, cats, held, knobs.classification_model, knobs.random_state, knobs.rf_trees,
                knobs.rf_max_depth, knobs.test_fraction, knobs.max_onehot_categories), "predictions")
            out["classification_metrics"] = M.classification_metrics(pred, df.select(target), knobs.classification_model)
            out["confusion_matrix"] = M.confusion_matrix(pred)
        else:
            pred = scratch_table(M.regress(
                df, target, nums, cats, held, knobs.regression_model, knobs.ridge_alpha, knobs.random_state,
                knobs.rf_trees, knobs.rf_max_depth, knobs.test_fraction, knobs.max_onehot_categories), "predictions")
            rows = df.agg(F.count(number_of(df, target)))
            out["regression_metrics"] = M.regression_metrics(pred, rows, knobs.regression_model)
            out["actual_vs_predicted"] = pred
    if "text" in tasks:
        ok = text_col is not None and text_col in df.columns
        status.append(M.gate("text", ok, "No text column"))
        if ok:
            out["column"] = X.text_stats(df, text_col, held)
            out["top_keywords"] = X.top_keywords(df, text_col, knobs.keyword_features, knobs.keywords)
            out["summaries"] = X.extractive_summary(df, text_col, held, knobs.summary_sentences)
    out["status"] = spark.createDataFrame(status, "task string, status string, reason string")
    out["plain_english"] = plain_english(df, out)
    return out


def plain_english(df: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """The run's findings as one row of text, a line per finding."""
    # The lines of the run summary.
    none = "- No major results were produced (check config knobs and target columns)."
    lines = {
        "describe": (df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns))),
                     "- The dataset has **%d rows** and **%d columns**.", ("rows", "cols")),
        "classification_metrics": (None, "- Classification performance: accuracy=%.3f, F1=%.3f.", ("accuracy", "f1")),
        "regression_metrics": (None, "- Regression performance: MAE=%.3f, RMSE=%.3f, R²=%.3f.", ("mae", "rmse", "r2")),
        "anomaly_summary": (None, "- Detected ~%.2f%% anomalies in numeric patterns.", ("percent",)),
        "summaries": (None, "- Extracted a short summary of the text content.", ()),
    }
    found = [k for k in lines if k in results]
    parts = []
    for i, k in enumerate(found):
        frame, text, args = lines[k]
        one = frame if frame is not None else results[k]
        if k == "anomaly_summary":
            one = one.withColumn("percent", F.col("anomaly_fraction") * 100)
        elif k == "summaries":
            one = one.agg(F.count(F.lit(1)).alias("n"))
        parts.append(one.select(F.lit(i).alias("i"), F.format_string(text, *args).alias("line")))
    if not parts:
        return df.sparkSession.createDataFrame([(none,)], "plain_english string")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]),
                                  "\n").alias("plain_english"))


def _supervised_gate(df: DataFrame, task: str, target: str | None) -> str | None:
    """Why a supervised task cannot run; None if it can."""
    # The reasons reported for skipped tasks.
    if not target:
        return f"No {task}_target provided"
    if target not in df.columns:
        return f"Target column not found: {target}"
    if task == "classification":
        classes = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(2).count()
        return None if classes >= 2 else "Target has <2 classes"
    numbers = df.filter(number_of(df, target).isNotNull()).limit(50).count()
    return None if numbers >= 50 else "Too few numeric target rows"

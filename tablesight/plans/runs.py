"""Run reports, run listing and run comparison.

A run's measures are kept in long form ``(run_id, mode, metric, value)`` so
any number of runs stack into one table; a report is a set of folders named by
``run_id``, of which the manifest is written last and listed back.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.frames import Frames
from tablesight.session import scratch_scope

# The metrics compared per mode, in display order.
COMPARE_METRICS = {
    "clinic": ["total_revenue_collected", "total_visits", "no_show_rate"],
    "trading": ["total_pnl", "win_rate", "max_drawdown"],
}
DEFAULT_COMPARE = ["rows", "cols"]


def metrics_long(kpis: DataFrame, run_id: str, mode: str) -> DataFrame:
    """One-row KPI frame -> (run_id, mode, metric, value) for its numeric
    columns."""
    nums = [f.name for f in kpis.schema.fields if isinstance(f.dataType, T.NumericType)]
    wide = kpis.select(*[F.col(c).cast("double").alias(c) for c in nums])
    long = wide.unpivot([], nums, "metric", "value")
    return long.select(F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), "metric", "value")


def compare_runs(metrics: DataFrame, run_a: str, run_b: str, mode: str) -> DataFrame:
    """The mode's chosen metrics of two runs side by side; a metric a run
    lacks is NULL (left join of the metric list to each run)."""
    names = COMPARE_METRICS.get(mode, DEFAULT_COMPARE)
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(m, i) for i, m in enumerate(names)], "metric string, pos int")
    a = metrics.filter(F.col("run_id") == run_a).select("metric", F.col("value").alias("run_a"))
    b = metrics.filter(F.col("run_id") == run_b).select("metric", F.col("value").alias("run_b"))
    return wanted.join(a, "metric", "left").join(b, "metric", "left")


def new_run_id() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S") + "_" + uuid.uuid4().hex[:8]


RUN_SCHEMA = ("run_id string, created_at string, input string, mode string, rows long, cols int, "
              "summary string, mapping map<string,string>, warnings array<string>")
METRIC_SCHEMA = "mode string, metric string, value double"


def write_report(metrics: DataFrame, tables: Mapping[str, DataFrame], base: str, run_id: str,
                 meta: dict | None = None) -> str:
    """K3: a run's folder under ``base``: metrics as JSON in
    ``metrics/run_id=<id>``, each table as parquet in
    ``tables/<name>/run_id=<id>``, and last of all its manifest, one meta row (run
    id, created_at, input, mode, rows, cols, summary, the inferred column mapping
    and the warnings) in ``runs/run_id=<id>``.

    A run counts once its manifest does: Spark commits a folder with the marker
    file ``_SUCCESS``, and nothing of a run is listed before.  Writing a run id
    again first withdraws its manifest and then replaces all that it held, so a
    retry of a failed or repeated run leaves one whole run.
    """
    spark = metrics.sparkSession
    manifest = f"{base}/runs/run_id={run_id}"
    _remove(spark, manifest)
    metrics.select("mode", "metric", "value").write.mode("overwrite").json(f"{base}/metrics/run_id={run_id}")
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{base}/tables/{name}/run_id={run_id}")
    m = dict(meta or {})
    row = (run_id, m.get("created_at") or _dt.datetime.now(_dt.timezone.utc).isoformat(),
           m.get("input"), m.get("mode"), m.get("rows"), m.get("cols"), m.get("summary"),
           m.get("mapping") or {}, m.get("warnings") or [])
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("overwrite").json(manifest)
    return run_id


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def committed_runs(spark: SparkSession, base: str) -> list[str]:
    """Run ids with a committed manifest: one listing of marker files."""
    files, at = _path(spark, f"{base}/runs/run_id=*/_SUCCESS")
    found = files.globStatus(at) or []
    return sorted(s.getPath().getParent().getName().removeprefix("run_id=") for s in found)


def _of_runs(spark: SparkSession, base: str, kind: str, schema: str, run_ids: list[str]) -> DataFrame:
    """The JSON rows of some runs, with their run_id."""
    paths = [f"{base}/{kind}/run_id={r}" for r in run_ids]
    if not paths:
        return spark.createDataFrame([], f"{schema}, run_id string")
    return spark.read.schema(f"{schema}, run_id string").option("basePath", f"{base}/{kind}").json(paths)


def report(df: DataFrame, mode: str, base: str, source: str, run_id: str | None = None,
           created_at: str | None = None, overrides: dict | None = None) -> str:
    """One run over a table: its pack's measures and tables, its profile, the
    mapping in use and the quality warnings, written as K3.  The run owns the
    scratch tables that it needs and drops them when it ends."""
    from tablesight.operators import profile as P
    from tablesight.plans import packs as K
    run_id = run_id or new_run_id()
    mapping = K.resolve_mapping(df.columns, overrides)
    with scratch_scope(df.sparkSession):
        res = K.get_pack(mode)(df, mapping)
        kpis = res["kpis"]
        warnings = [f"{r['code']}: {r['detail']}" for r in P.quality_checks(df).collect()]   # a row per finding
        first = kpis.select("summary").first() if "summary" in kpis.columns else None
        tables = Frames().adopt(res).adopt(K.table_profile(df), "profile_")
        return write_report(
            metrics_long(kpis, run_id, mode), tables, base, run_id,
            {"input": source, "mode": mode, "rows": df.count(), "cols": len(df.columns), "created_at": created_at,
             "summary": first[0] if first else None, "mapping": mapping, "warnings": warnings})


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """One row per committed run, newest first."""
    runs = _of_runs(spark, base, "runs", RUN_SCHEMA.removeprefix("run_id string, "), committed_runs(spark, base))
    return runs.select("run_id", *[f.split()[0] for f in RUN_SCHEMA.split(", ")[1:]]).orderBy(
        F.desc("created_at"), F.desc("run_id"))


def read_metrics(spark: SparkSession, base: str) -> DataFrame:
    """The measures of the committed runs (run_id, mode, metric, value)."""
    return _of_runs(spark, base, "metrics", METRIC_SCHEMA, committed_runs(spark, base)).select(
        "run_id", "mode", "metric", "value")

"""Packs as lazy frames, scratch tables owned by runs, and the run store."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablesight.frames import Frames, shared
from tablesight.plans import packs as K
from tablesight.plans import runs as R
from tablesight.plans import standins as S
from tablesight.session import checkpoint_dir, scratch_scope, scratch_table


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_frames_build_once_on_use():
    calls = []
    base = shared(lambda: calls.append("base") or "rows")
    f = Frames({"a": lambda: calls.append("a") or base()})
    f["b"] = lambda: calls.append("b") or base()
    both = Frames().adopt(f, "x_")
    assert list(both) == ["x_a", "x_b"] and "x_a" in both and not calls
    assert both["x_a"] == f["a"] == f["b"] == "rows"
    assert calls == ["a", "base", "b"]
    with pytest.raises(KeyError):
        f["c"]
    with pytest.raises(TypeError):
        f["d"] = "no function"


def test_building_packs_starts_no_job(spark, sf_small):
    tables = [(K.trading_trades, S.trade_log(spark, sf_small)), (K.trading_equity, S.equity_curve(spark, sf_small)),
              (K.clinic_vitals, S.vitals_gaps(spark, sf_small)), (K.clinic_general, S.visits(spark, sf_small)),
              (K.clinic_lab, S.lab_results(spark, sf_small)), (K.clinic_billing, S.billing(spark, sf_small)),
              (K.trading_backtest, S.backtest_monthly(spark, sf_small)), (K.universal_kpis, S.generic_table(spark, sf_small))]
    for pack, df in tables:
        out, jobs = _jobs(spark, lambda p=pack, t=df: p(t, K.resolve_mapping(t.columns)))
        assert jobs == 0 and "kpis" in out, pack.__name__
    g = S.generic_table(spark, sf_small)
    assert _jobs(spark, lambda: (K.table_profile(g), K.table_describe(g)))[1] == 0


def test_measures_write_nothing(spark, sf_small):
    t = S.trade_log(spark, sf_small)
    root = checkpoint_dir(spark)
    before = set(os.listdir(root.removeprefix("file:")))
    K.trading_trades(t, K.resolve_mapping(t.columns))["kpis"].collect()
    g = S.generic_table(spark, sf_small)
    K.table_profile(g)["kpis"].collect()
    assert set(os.listdir(root.removeprefix("file:"))) == before


def test_scopes_drop_their_tables(spark):
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with scratch_scope(spark):
        kept = scratch_table(spark.range(3), "outer")
        with pytest.raises(ZeroDivisionError):
            with scratch_scope(spark):
                scratch_table(spark.range(3), "inner")
                1 / 0
        assert kept.count() == 3 and len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) == before


def test_a_report_leaves_no_scratch_and_is_listed(spark, sf_small, tmp_path):
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    v = S.vitals_gaps(spark, sf_small)
    base = f"{tmp_path}/reports"
    R.report(v, "clinic", base, "vitals", "run_1", "2024-01-01T00:00:00")
    assert set(os.listdir(root)) == before
    row = R.list_runs(spark, base).first()
    assert (row.run_id, row.mode, row.input) == ("run_1", "clinic", "vitals")
    assert spark.read.parquet(f"{base}/tables/series/run_id=run_1").count() == v.count()


def test_a_failed_run_is_not_listed_and_a_retry_replaces(spark, tmp_path):
    base = f"{tmp_path}/reports"
    assert R.list_runs(spark, base).count() == 0 and R.read_metrics(spark, base).count() == 0
    kpis = R.metrics_long(spark.createDataFrame([(1, 2.0)], "rows int, total double"), "r1", "universal")
    good = {"t": spark.range(3).toDF("a")}
    bad = {"t": spark.range(3).toDF("a"), "u": spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))}
    with pytest.raises(Exception):
        R.write_report(kpis, bad, base, "r1")
    assert R.list_runs(spark, base).count() == 0 and R.read_metrics(spark, base).count() == 0
    for _ in range(2):   # a retry, and a repeated run
        R.write_report(kpis, good, base, "r1", {"created_at": "2024-01-01"})
    R.write_report(kpis, good, base, "r2", {"created_at": "2024-02-01"})
    assert [r.run_id for r in R.list_runs(spark, base).collect()] == ["r2", "r1"]
    assert R.read_metrics(spark, base).groupBy("run_id").count().collect() == [("r1", 2), ("r2", 2)] or \
        {tuple(r) for r in R.read_metrics(spark, base).groupBy("run_id").count().collect()} == {("r1", 2), ("r2", 2)}
    with pytest.raises(Exception):   # a repeated run that fails is withdrawn
        R.write_report(kpis, bad, base, "r1")
    assert [r.run_id for r in R.list_runs(spark, base).collect()] == ["r2"]

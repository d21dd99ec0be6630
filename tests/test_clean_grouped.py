import datetime as dt
import math

from pyspark.sql import functions as F

from tablesight.operators import clean as C
from tablesight.operators import grouped as G


def test_normalize_and_dedupe(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Net Price ($)", "A b", "a_b", "%%"])
    assert C.normalize_columns(df).columns == ["net_price_", "a_b", "a_b__2", "col"]
    assert C.sanitize_columns(df.drop("a_b")).columns == ["Net_Price_", "A_b", "col"]


def test_impute_median_fills_nan_null_inf(spark):
    rows = [(1.0,), (2.0,), (float("nan"),), (None,), (float("inf"),), (10.0,)]
    df = spark.createDataFrame(rows, "x double")
    got = [r.x for r in C.impute_median(df).collect()]
    med = 6.0      # median of 1, 2, 10, inf (infinities count, as in pandas)
    assert got == [1.0, 2.0, med, med, med, 10.0]


def test_clean_table_is_idempotent(spark):
    rows = [(1, "a", None, 1.0), (2, None, None, None), (3, "c", None, 3.0)]
    df = spark.createDataFrame(rows, "ID int, Name string, empty string, V double")
    once = C.clean_table(df)
    twice = C.clean_table(once)
    assert once.columns == ["id", "name", "v"]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_parse_epoch_scales(spark):
    df = spark.createDataFrame([(1704067200, 1704067200123, 5)], "s long, ms long, small long")
    out = C.parse_epoch(df, fine=True).first()
    assert out.s == dt.datetime(2024, 1, 1) and out.small == 5
    assert out.ms == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_trade_stats_zero_is_loss_and_no_losses(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (-5.0,), (None,)], "p double")
    r = G.trade_stats(df, "p").first()
    assert r.total_trades == 4 and r.win_rate == 0.25
    assert math.isclose(r.avg_loss, -5.0 / 3) and r.profit_factor == 2.0
    only_wins = spark.createDataFrame([(1.0,), (2.0,)], "p double")
    assert G.trade_stats(only_wins, "p").first().profit_factor is None


def test_week_starts_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12), 1.0), (dt.datetime(2024, 1, 8), 2.0)],
                               "t timestamp_ntz, a double")
    got = [(r.period, r.amount) for r in G.sum_by_period(df, "t", "a", "week").collect()]
    assert got == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 8), 2.0)]


def test_order_rates_unfilled_counts_as_filled(spark):
    df = spark.createDataFrame([("FILLED",), ("unfilled",), ("rejected",), ("Cancelled",), (None,)],
                               "status string")
    r = G.order_rates(df).first()
    assert r.fill_rate == 0.4 and r.rejection_rate == 0.4


def test_repeat_rate_and_share(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "pid int")
    assert G.repeat_rate(df, "pid").first()[0] == 5 / 6
    shares = G.top_keys_by_count(df, "pid", 10).agg(F.sum("share")).first()[0]
    assert abs(shares - 1.0) < 1e-12


def test_best_worst_ties_take_first(spark):
    df = spark.createDataFrame([("2024-01", 5.0), ("2024-02", 9.0), ("2024-03", 9.0), ("2024-04", -1.0)],
                               "m string, v double")
    r = G.best_worst(df, "m", "v", ["m"]).first()
    assert (r.best_label, r.worst_label) == ("2024-02", "2024-04")

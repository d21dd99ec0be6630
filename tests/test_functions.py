import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tablesight.functions import scalars as S


def _one(spark, col, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_to_number_rejects_java_suffixes(spark):
    got = _one(spark, S.to_number, ["12", " 1e3 ", "12f", "", "abc", "-.5", "+3.", None, "1d"])
    assert got == [12.0, 1000.0, None, None, None, -0.5, 3.0, None, None]


def test_to_number_nan_is_null(spark):
    got = _one(spark, S.to_number, [float("nan"), 1.5, None], "double")
    assert got == [None, 1.5, None]


@pytest.mark.parametrize("raw,cls", [
    ("No-Show", "no_show"), ("no_show", "no_show"), ("NOSHOW", "no_show"), ("CXL", "cancelled"),
    ("canceled", "cancelled"), ("Cancelled by patient", "cancelled"), ("Done", "completed"),
    ("attended", "completed"), ("unfilled", "other"), (None, "other"), ("no show, cancelled", "no_show"),
])
def test_status_class(spark, raw, cls):
    assert _one(spark, S.status_class, [raw]) == [cls]


TEXTS = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\nx", "x y", "one. two! three?",
         "tab\tsep", "héllo wörld_1 ²", "a\x0bb\x0c"]


def test_line_count_matches_splitlines(spark):
    got = _one(spark, S.line_count, TEXTS)
    assert got == [len(t.splitlines()) for t in TEXTS]


def test_word_count_matches_python(spark):
    got = _one(spark, S.word_count, TEXTS)
    assert got == [len(re.findall(r"\w+", t)) for t in TEXTS]


def test_sentences_match_python(spark):
    texts = ["One. Two!  Three? four", "no end", "  A.  B.  ", "", "x... y"]
    got = _one(spark, S.sentences, texts)
    want = [[s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] for t in texts]
    assert got == want


def test_parse_ts_formats(spark):
    got = _one(spark, lambda c: S.parse_ts(c), [
        "2024-01-02", "1/2/2024", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T23:30:00-02:00",
        "2024-01-02T03:04:05.250", "2.1.2024", "20240102", "2024/01/02 03:04:05", "13/45/2024", "bad", "12345", None])
    day = dt.datetime(2024, 1, 2)
    time = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [day, day, time, time, dt.datetime(2024, 1, 3, 1, 30), time.replace(microsecond=250000), day, day, time,
                   None, None, None, None]


def test_numbers_by_type(spark):
    from pyspark.sql import types as T
    inf = float("inf")
    assert _one(spark, S.to_number, ["inf", " -Infinity", "nan", "+INF"]) == [inf, -inf, None, inf]
    assert _one(spark, lambda c: S.to_number(c, T.DoubleType()), [inf, 1.5, float("nan")], "double") == [inf, 1.5, None]
    assert _one(spark, lambda c: S.to_number(c, T.BooleanType()), [True, False, None], "boolean") == [1.0, 0.0, None]


def test_epochs_stay_whole_and_in_range(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1700000000123456789, 10 ** 17, -1500)], "ns long, ms long, us long")
    r = df.select(S.epoch_to_ts("ns", "ns", T.LongType()).alias("ns"), S.epoch_to_ts("ms", "ms", T.LongType()).alias("ms"),
                  S.epoch_to_ts("us", "us", T.LongType()).alias("us")).first()
    assert r.ns == dt.datetime(2023, 11, 14, 22, 13, 20, 123456) and r.ms is None
    assert r.us == dt.datetime(1969, 12, 31, 23, 59, 59, 998500)


def test_epoch_units(spark):
    df = spark.createDataFrame([(1704067200, 1704067200000)], "s long, ms long")
    r = df.select(S.epoch_to_ts("s", "s").alias("a"), S.epoch_to_ts("ms", "ms").alias("b")).first()
    assert r.a == r.b == dt.datetime(2024, 1, 1)


def test_currency_format(spark):
    got = _one(spark, lambda c: S.currency(c, "$"), [1234.5, -0.125, None], "double")
    assert got == ["$1,234.50", "$-0.13", "N/A"] or got == ["$1,234.50", "$-0.12", "N/A"]

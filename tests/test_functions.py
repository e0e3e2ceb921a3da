"""Boundary cases of the PostgreSQL-compatible column helpers."""

import datetime as dt

from pyspark.sql import functions as F

from cadenza.functions import day_abbrev, dow_sunday0, month_abbrev, pg_concat, plus_months, whole_days
from cadenza.operators.rules import duration_ok


def test_plus_months_clamps_and_keeps_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 13, 45),), (dt.datetime(2023, 2, 28, 0, 0),)],
                               "t timestamp_ntz")
    got = [r.x for r in df.select(plus_months("t", 1).alias("x")).collect()]
    assert got == [dt.datetime(2024, 2, 29, 13, 45), dt.datetime(2023, 3, 28, 0, 0)]


def test_duration_equality_passes(spark):
    start = dt.datetime(2023, 1, 15, 10)
    df = spark.createDataFrame([(start, dt.datetime(2024, 1, 15, 10)), (start, dt.datetime(2024, 1, 15, 10, 0, 1))],
                               "s timestamp_ntz, e timestamp_ntz")
    assert [r.ok for r in df.select(duration_ok("s", "e", 12).alias("ok")).collect()] == [True, False]


def test_whole_days_truncates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30, 23)),
                                (dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 11))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r.d for r in df.select(whole_days("a", "b").alias("d")).collect()] == [29, 0]


def test_concat_skips_nulls(spark):
    df = spark.createDataFrame([("Anna", None), (None, None)], "a string, b string")
    assert [r.x for r in df.select(pg_concat("a", F.lit(" "), "b").alias("x")).collect()] == ["Anna ", " "]


def test_dates_as_text(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 1),), (dt.date(2024, 12, 7),)], "d date")
    got = [tuple(r) for r in df.select(dow_sunday0("d"), day_abbrev("d"), month_abbrev("d")).collect()]
    assert got == [(0, "Sun", "Dec"), (6, "Sat", "Dec")]

"""Scalar functions against Python's own conversions (int, Decimal,
datetime.strptime, str.strip) on tricky inputs."""

from datetime import datetime
from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedmerge.functions import (format_datetime, format_decimal, parse_datetime, parse_decimal, parse_int,
                                 round_increment, stage_index, strip_ws)

INTS = [" 5 ", "+5", "-0", "007", "5.0", "1e3", "1_000", "1__0", "_1", "1_", "", "  ", "\t7\n", "abc",
        "99999999999", "-12", None]
DECIMALS = ["10.5", " 1.5 ", "1e3", "1E+3", ".5", "5.", "1_000.5", "_1", "1_", "NaN", "-Infinity", "inf",
            "abc", "", None, "-0.001", "12.3456"]
DATES = ["2020-1-2 3:4:5", "2020-01-02", "2020-1-2T03:04:05", "20-01-02", "2020-01-02 03:04:05.5",
         "2020-01-02T03:04:05Z", "2020-02-30", " 2020-01-02 ", "", None, "01/02/2020"]


def py_int(v):
    if v is None or not v.strip():
        return None, None
    try:
        return int(v.strip()), None
    except ValueError:
        return None, f"invalid int: {v}"


def py_dec(v):
    if v is None or not v.strip():
        return None, None
    try:
        d = Decimal(v.strip())
    except InvalidOperation:
        return None, f"invalid decimal: {v}"
    return (d if d.is_finite() else None), None


def py_dt(v):
    if v is None or not v.strip():
        return None, None
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(v.strip(), fmt), None
        except ValueError:
            continue
    return None, f"invalid datetime: {v}"


def _run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    p = fn(F.col("raw"))
    return df.select("raw", p.value.alias("value"), p.error.alias("error")).collect()


def test_parse_int_matches_python(spark):
    for r in _run(spark, INTS, parse_int):
        want, err = py_int(r.raw)
        if want is not None and abs(want) >= 2 ** 63:   # documented: bigint range
            assert r.value is None and r.error is not None
            continue
        assert (r.value, r.error) == (want, err), r.raw


def test_parse_decimal_matches_python(spark):
    for r in _run(spark, DECIMALS, parse_decimal):
        want, err = py_dec(r.raw)
        assert r.error == err, r.raw
        if want is not None:
            assert r.value == want.quantize(Decimal("0.000001")), r.raw
        else:
            assert r.value is None, r.raw


def test_nonfinite_decimal_is_model_invalid(spark):
    df = spark.createDataFrame([("NaN",), ("-Infinity",), ("1.5",)], "raw string")
    p = parse_decimal(F.col("raw"))
    got = [r.i for r in df.select(p.invalid.alias("i")).collect()]
    assert got == ["Input should be a finite number", "Input should be a finite number", None]


def test_parse_datetime_matches_python(spark):
    for r in _run(spark, DATES, parse_datetime):
        want, err = py_dt(r.raw)
        assert (r.value, r.error) == (want, err), r.raw


def test_parse_datetime_fields_have_pythons_widths(spark):
    dates = ["2020-001-02", "+12020-01-02", "2020-01-02 003:04:05", "2020", "2020-01", "2020-01-02T03:04",
             "2020-01-02 03:04:05 UTC", "2020-1-2 24:00:00", "2021-2-29T1:2:3", "2020-2-29T1:2:3"]
    for r in _run(spark, dates, parse_datetime):
        assert (r.value, r.error) == py_dt(r.raw), r.raw


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\xa0 abc1", max_size=8), min_size=1, max_size=20))
def test_strip_ws_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    got = [r.s for r in df.select(strip_ws(F.col("raw")).alias("s")).collect()]
    assert got == [v.strip() for v in values]


@pytest.mark.parametrize("value,inc,expected", [
    ("25.00", "0.99", "24.75"), ("23.988", "0.01", "23.99"), ("10.005", "0.01", "10.01"),
    ("29.988", "0.99", "29.70"), ("7.5", "0", "7.5"), ("7.5", "-1", "7.5"), ("2.5", "1", "3"),
])
def test_round_increment_half_up(spark, value, inc, expected):
    df = spark.createDataFrame([(Decimal(value), Decimal(inc))], "v decimal(30,12), i decimal(18,6)")
    got = df.select(round_increment(F.col("v"), F.col("i")).alias("r")).first().r
    assert got == Decimal(expected)


@pytest.mark.parametrize("value,expected", [("25.005", "25.00"), ("25.015", "25.02"), ("9.9", "9.90"),
                                            ("10", "10.00"), ("-0.125", "-0.12")])
def test_format_decimal_half_even(spark, value, expected):
    df = spark.createDataFrame([(Decimal(value),)], "v decimal(18,6)")
    assert str(df.select(format_decimal(F.col("v")).alias("f")).first().f) == expected


def test_format_datetime(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 12, 0, 0),), (datetime(2020, 1, 1, 12, 0, 0, 1234),)],
                               "t timestamp")
    got = [r.f for r in df.select(format_datetime(F.col("t")).alias("f")).collect()]
    assert got == ["2020-01-01T12:00:00Z", "2020-01-01T12:00:00.001234Z"]


def test_stage_index(spark):
    df = spark.createDataFrame([("QUEUE",), ("COMPLETE",), ("NOPE",)], "s string")
    assert [r.i for r in df.select(stage_index(F.col("s")).alias("i")).collect()] == [0, 5, -1]


def test_basename_matches_posix_path(spark):
    from pathlib import PurePosixPath
    from feedmerge.functions import basename
    keys = ["inbound/t/v/feed.csv", "a/b/", "x.csv", "", "a//b", "/"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r.b for r in df.select(basename(F.col("k")).alias("b")).collect()]
    assert got == [PurePosixPath(k).name or "inbound" for k in keys]

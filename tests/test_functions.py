"""Scalar helpers: date parsing, canonical symbols, rating classes, consensus bins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import month_add, month_start, parse_yyyymmdd, parse_yyyymmdd_strict
from tidemark.functions.text import canonical_symbol, rating_class


def test_parse_dates_lenient(spark):
    df = spark.createDataFrame([("20241301",), ("",), ("2024-01-02",), ("20240102",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_yyyymmdd("s")).collect()] == [
        None, None, dt.date(2024, 1, 2), dt.date(2024, 1, 2), None]


def test_parse_dates_strict_raises(spark):
    df = spark.createDataFrame([("20241301",)], "s string")
    with pytest.raises(Exception):
        df.select(parse_yyyymmdd_strict("s")).collect()


def test_month_helpers(spark):
    df = spark.createDataFrame([("202412",)], "m string")
    r = df.select(month_start("m"), month_add("m", 1), month_add("m", 6)).collect()[0]
    assert tuple(r) == (dt.date(2024, 12, 1), "202501", "202506")


@pytest.mark.parametrize("code,market,want", [
    ("600000", "SH", "600000.SH"), ("600000", "st", "600000.SH"), ("000001", "SZ", "000001.SZ"),
    ("HK0189", "177", "00189.HK"), ("HK00700", "177", "00700.HK"), ("AAPL", "185", "AAPL.US"),
    ("300750", "CYB", "300750.SZ"), ("002594", "CYB", None), ("688981", "KC", "688981.SH"),
    ("000300", "120", None), ("600000", None, None), ("430047", "BJ", "430047.BJ"),
])
def test_canonical_symbol(spark, code, market, want):
    df = spark.createDataFrame([(code, market)], "code string, market string")
    assert df.select(canonical_symbol("code", "market")).collect()[0][0] == want


def test_rating_class(spark):
    df = spark.createDataFrame([("买入",), ("增持",), ("卖出",), ("Strong BUY",), ("sell",), ("",), (None,)],
                               "r string")
    assert [x[0] for x in df.select(rating_class("r")).collect()] == ["buy", "hold", "sell", "buy", "sell", "", ""]


def test_like_is_case_sensitive(spark):
    df = spark.createDataFrame([("Alpha",)], "s string")
    assert df.where(F.col("s").like("%alpha%")).count() == 0

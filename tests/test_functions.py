from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillcast.functions import (
    date_from_key,
    key_from_date,
    month_index,
    positive_flag,
    quarter_of_month,
    shipping_days,
    truncated_mean,
    two_decimals,
    zero_if_null,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def key(value):
    return F.lit(value).cast("int")


@pytest.mark.parametrize("value", [20240229, 20201231, 10000101, 99991231])
def test_date_from_key(spark, value):
    text = str(value)
    expected = date(int(text[:4]), int(text[4:6]), int(text[6:]))
    assert one(spark, date_from_key(key(value))) == expected


def test_missing_date_key_stays_missing(spark):
    assert one(spark, date_from_key(key(None))) is None


@pytest.mark.parametrize("value", [0, -1, 950101, 20230229, 20231301, 202401011])
def test_bad_date_key_raises(spark, value):
    with pytest.raises(PySparkException):
        one(spark, date_from_key(key(value)))


@given(days=st.lists(st.dates(date(1753, 1, 1), date(9999, 12, 31)), min_size=1, max_size=50))
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
def test_date_keys_round_trip(spark, days):
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    back = frame.select("d", date_from_key(key_from_date(F.col("d"))).alias("back")).collect()
    assert all(r["d"] == r["back"] for r in back)


def test_shipping_days_are_signed(spark):
    assert one(spark, shipping_days(key(20200228), key(20200302))) == 3
    assert one(spark, shipping_days(key(20200105), key(20200101))) == -4
    assert one(spark, shipping_days(key(20200105), key(None))) is None


@pytest.mark.parametrize(
    ("values", "expected"),
    [([-3, -4], -3), ([3, 4], 3), ([-1, 0], 0), ([5, None], 5), ([None, None], None), ([2], 2)],
)
def test_truncated_mean(spark, values, expected):
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    assert frame.agg(truncated_mean(F.col("v")).alias("x")).first()["x"] == expected


def test_quarters(spark):
    got = spark.range(1, 13).select(quarter_of_month(F.col("id")).alias("q")).collect()
    assert [r["q"] for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_month_index(spark):
    assert one(spark, month_index(F.lit(2001), F.lit(3), F.lit(1999))) == 27


def test_defaults_and_flags(spark):
    assert one(spark, zero_if_null(key(None))) == 0
    assert one(spark, zero_if_null(key(3))) == 3
    assert [one(spark, positive_flag(key(v))) for v in (None, 0, -1, 2)] == [0, 0, 0, 1]


def test_report_text(spark):
    assert one(spark, two_decimals(F.lit(0.9670227))) == "0.97"
    assert one(spark, two_decimals(F.lit(1234567.0))) == "1234567.00"

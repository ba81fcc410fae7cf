import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillcast.operators.encoding import (
    Categories,
    align_columns,
    category_vocabulary,
    indicator_columns,
    indicator_names,
    with_indicators,
)
from tillcast.operators.scaling import Scaler
from tillcast.operators.split import hash_bucket, holdout_split
from tillcast.plans.features import mart_facts


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "M", 10), (2, "F", 2), (3, None, 2), (4, "X", None), (5, "F", 10)],
        "id int, Gender string, EmailPromotion int",
    )


def test_vocabulary_sorts_numbers_as_numbers(people):
    got = rows(category_vocabulary(people, ["Gender", "EmailPromotion"]))
    assert got == [
        ("EmailPromotion", 0, "2"),
        ("EmailPromotion", 1, "10"),
        ("Gender", 0, "F"),
        ("Gender", 1, "M"),
        ("Gender", 2, "X"),
    ]


def indicators(frame, columns, given=None):
    categories = given or mart_facts(frame.withColumn("Year", F.lit(1)), columns).categories
    added, names = with_indicators(frame, categories, columns)
    return indicator_columns(added, names), names


def test_first_category_is_the_base_level(people):
    frame, names = indicators(people, ["EmailPromotion", "Gender"])
    assert names == ["EmailPromotion_10", "Gender_M", "Gender_X"]
    assert rows(frame, "id", *names) == [
        (1, 1.0, 1.0, 0.0),
        (2, 0.0, 0.0, 0.0),
        (3, 0.0, 0.0, 0.0),
        (4, 0.0, 0.0, 1.0),
        (5, 1.0, 0.0, 0.0),
    ]
    assert frame.columns == [*people.columns, *names]


def test_unseen_category_gets_zeros(spark):
    new = spark.createDataFrame([("Q",), ("M",)], "Gender string")
    frame, names = indicators(new, ["Gender"], Categories({"Gender": ["F", "M"]}))
    assert rows(frame, *names) == [(0.0,), (1.0,)]


def test_names_without_dots_and_without_clashes():
    assert indicator_names("C", ["A", "St. Lucia", "St_ Lucia"]) == ["C_St_ Lucia", "C_St_ Lucia_2"]


@pytest.mark.parametrize("many", [1, 2, 60, 300])
def test_one_sparse_vector_for_any_number_of_categories(spark, many):
    values = [f"v{i:03}" for i in range(many)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, Kind string")
    told, names = indicators(frame, ["Kind"])
    assert names == [f"Kind_{v}" for v in values[1:]]
    got = rows(told, "id", *names)
    assert got == sorted(
        ((i, *(float(v == values[i]) for v in values[1:])) for i in range(many)), key=repr
    )
    vector, _ = with_indicators(frame, mart_facts(frame.withColumn("Year", F.lit(1)), ["Kind"]).categories, ["Kind"])
    assert vector.columns == ["id", "Kind", *["Indicators"] * (many > 1)]


def test_names_that_differ_by_case(spark):
    frame = spark.createDataFrame([(1, "US"), (2, "us"), (3, "AT")], "id int, Country string")
    told, names = indicators(frame, ["Country"])
    assert names == ["Country_US", "Country_us_2"]
    assert rows(told, "id", *names) == [(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0)]


def test_categories_round_trip(spark):
    held = Categories({"Gender": ["F", "M"], "EmailPromotion": ["2", "10"]})
    assert Categories.from_df(held.to_df(spark)) == held


def test_indicators_need_no_pass_over_the_frame(spark, people):
    """The encoder is told the number of slots: adding indicators runs no job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("indicators", "indicators")
    try:
        with_indicators(people, Categories({"Gender": ["F", "M", "X"]}), ["Gender"])
        assert tracker.getJobIdsForGroup("indicators") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_align_adds_drops_and_orders(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, b double, a double, extra double")
    got = align_columns(frame, ["a", "b", "missing"], keep=["id"])
    assert got.columns == ["id", "a", "b", "missing"]
    assert rows(got) == [(1, 3.0, 2.0, 0.0)]


def test_scaling_uses_the_population_deviation(spark):
    frame = spark.createDataFrame([(1, 5), (2, 5), (4, 5)], "x int, constant int")
    scaler = Scaler.fit(frame, ["x", "constant"])
    mean, std = 7 / 3, math.sqrt(14 / 9)
    assert scaler.stats["x"] == pytest.approx((mean, std))
    assert scaler.stats["constant"] == (5.0, 1.0)
    got = rows(scaler.transform(frame))
    assert [g[1] for g in got] == [0.0, 0.0, 0.0]
    assert sorted(g[0] for g in got) == pytest.approx([(v - mean) / std for v in (1, 2, 4)])


def test_scaler_round_trip(spark):
    scaler = Scaler({"a": (0.1, 1 / 3), "b": (-2.5e300, 1.0)})
    assert Scaler.from_df(scaler.to_df(spark)) == scaler


def test_split_is_stable_and_close_to_the_share(spark):
    frame = spark.range(5000).withColumn("k", F.col("id") % 2500)
    train, test = holdout_split(frame, ["k"])
    assert train.count() + test.count() == 5000
    assert train.select("k").intersect(test.select("k")).count() == 0
    assert 0.77 < train.count() / 5000 < 0.83
    again, _ = holdout_split(frame.repartition(7), ["k"])
    assert rows(train) == rows(again)


def test_buckets_cover_the_range(spark):
    got = spark.range(5000).select(hash_bucket(["id"]).alias("b")).agg(F.min("b"), F.max("b"))
    assert tuple(got.first()) == (0, 99)

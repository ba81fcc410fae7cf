import json

import pytest
from pyspark.errors import PySparkException

import tillcast as tc
from tests.conftest import line, rows
from tillcast.sources.star import CUSTOMERS, DATES, FACT, TERRITORIES, conform, jdbc_options
from tillcast.staging import scratch_root, stage, staged

SPLIT = {"partitionColumn": "SalesOrderID", "lowerBound": 1, "upperBound": 9, "numPartitions": 4}


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_parquet_star_gives_the_same_marts(make_star, folder, spark):
    star = make_star([line(1), line(2, day=20200203, customer=2, territory=2)])
    for name, table in [
        (FACT, star.fact),
        (DATES, star.dates),
        (TERRITORIES, star.territories),
        (CUSTOMERS, star.customers),
    ]:
        table.write.parquet(f"{folder}/{name}")
    stored = tc.parquet_star(spark, folder)
    assert stored.rescan_is_cheap
    for mart in (tc.monthly_sales, tc.monthly_demand, tc.regional_monthly, tc.customer_monthly):
        assert rows(mart(stored)) == rows(mart(star))
        assert mart(stored).dtypes == mart(star).dtypes


def test_value_that_does_not_fit_its_column_raises(spark):
    bad = spark.createDataFrame([("x", "North")], "TerritoryKey string, TerritoryName string")
    with pytest.raises(PySparkException):
        conform(bad, TERRITORIES).collect()


def test_jdbc_options_split_the_fact_scan():
    options = jdbc_options("dbo.Fact", {"url": "jdbc:example:", "user": "u"}, SPLIT)
    assert options == {
        "url": "jdbc:example:",
        "user": "u",
        "dbtable": "dbo.Fact",
        "partitionColumn": "SalesOrderID",
        "lowerBound": "1",
        "upperBound": "9",
        "numPartitions": "4",
    }
    with pytest.raises(ValueError, match="split needs"):
        jdbc_options("Fact", {}, {"partitionColumn": "SalesOrderID"})


def test_jdbc_star_reads_all_four_tables(spark, make_star):
    """A stand-in for the reader: no database runs in the tests."""
    source = make_star([line()])
    tables = {
        "dbo.Sales": source.fact,
        DATES: source.dates,
        TERRITORIES: source.territories,
        CUSTOMERS: source.customers,
    }
    seen = []

    class Reader:
        def format(self, name):
            assert name == "jdbc"
            return self

        def options(self, **options):
            self.chosen = options
            seen.append(options)
            return self

        def load(self):
            return tables[self.chosen["dbtable"]]

    class Session:
        read = Reader()

    splits = {FACT: SPLIT, CUSTOMERS: {**SPLIT, "partitionColumn": "CustomerKey"}}
    star = tc.jdbc_star(Session(), {"url": "jdbc:example:"}, splits, {FACT: "dbo.Sales"})
    assert rows(tc.monthly_sales(star)) == rows(tc.monthly_sales(source))
    assert [options.get("partitionColumn") for options in seen] == [
        "SalesOrderID", None, None, "CustomerKey",
    ]
    assert not star.rescan_is_cheap
    with pytest.raises(ValueError, match=CUSTOMERS):
        tc.jdbc_star(Session(), {}, {FACT: SPLIT})
    with pytest.raises(ValueError, match="DimNothing"):
        tc.jdbc_star(Session(), {}, {**splits, "DimNothing": SPLIT})


def test_records_keep_missing_fields(spark, folder):
    frame = spark.createDataFrame([(1, None), (2, 0.5)], "CustomerKey int, Probability double")
    records = sorted(r["value"] for r in tc.json_records(frame).collect())
    assert [json.loads(r) for r in records] == [
        {"CustomerKey": 1, "Probability": None},
        {"CustomerKey": 2, "Probability": 0.5},
    ]
    tc.write_results(frame, f"{folder}/json")
    texts = [r["value"] for r in spark.read.text(f"{folder}/json").collect()]
    assert sorted(texts) == records
    tc.write_results(frame, f"{folder}/parquet", fmt="parquet")
    assert rows(spark.read.parquet(f"{folder}/parquet")) == rows(frame)


def test_stored_mart_is_partitioned_by_year(retail, folder, spark):
    mart = tc.monthly_sales(retail)
    tc.write_mart(mart, f"{folder}/mart")
    stored = spark.read.parquet(f"{folder}/mart")
    assert rows(stored.select(*mart.columns)) == rows(mart)
    plan = stored.filter("Year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_staged_table_is_dropped(spark):
    with staged(spark.range(3), "numbers") as table:
        path = table.inputFiles()[0]
        assert path.startswith("file:") and scratch_root(spark) in path
        assert table.count() == 3
    with pytest.raises(PySparkException):
        spark.read.parquet(path)


def test_staged_table_is_dropped_after_a_failure(spark):
    with pytest.raises(RuntimeError, match="stop"), staged(spark.range(3), "numbers") as table:
        path = table.inputFiles()[0]
        raise RuntimeError("stop")
    with pytest.raises(PySparkException):
        spark.read.parquet(path)


def test_stage_keeps_the_schema(spark):
    frame = spark.range(3).selectExpr("id", "cast(id as decimal(19,4)) as money")
    assert stage(frame, "numbers").dtypes == frame.dtypes


def test_shared_folder_is_required_on_a_cluster():
    class Conf(dict):
        def get(self, name, default):
            return dict.get(self, name, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())
    Session.conf["spark.checkpoint.dir"] = "s3a://bucket/checkpoints/"
    assert scratch_root(Session()) == "s3a://bucket/checkpoints"

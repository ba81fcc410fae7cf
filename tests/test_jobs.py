"""The ten jobs: arguments, errors, least squares against numpy, forest properties."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tillcast as tc
from tests.conftest import line, rows
from tillcast.operators.calendar import month_spine, with_month_index
from tillcast.operators.customers import next_purchase_label
from tillcast.operators.profiles import future_from_profile
from tillcast.plans import wide_forest
from tillcast.plans.artefacts import load_model
from tillcast.plans.features import LINEAR_FEATURES
from tillcast.plans.models import CUSTOMER_FOREST, ForestSettings, above_half
from tillcast.staging import scratch_root, stage

SMALL = ForestSettings(trees=10, depth=4, bins=32)
GROUPED = ForestSettings(trees=7, depth=6, bins=256, groups=3)


@pytest.fixture(scope="module")
def marts(retail):
    return {
        "sales": stage(tc.monthly_sales(retail), "sales"),
        "demand": stage(tc.monthly_demand(retail), "demand"),
        "regional": stage(tc.regional_monthly(retail), "regional"),
        "customer": stage(tc.customer_monthly(retail), "customer"),
    }


@pytest.fixture(scope="module")
def models(retail, marts, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    paths = {name: str(root / name) for name in ("sales", "demand", "forest", "regional", "customer")}
    tc.train_sales(retail, paths["sales"], mart=marts["sales"])
    tc.train_demand(retail, paths["demand"], mart=marts["demand"])
    tc.train_sales_forest(retail, paths["forest"], mart=marts["sales"], settings=SMALL)
    tc.train_regional(retail, paths["regional"], mart=marts["regional"], settings=SMALL)
    tc.train_customer(retail, paths["customer"], mart=marts["customer"], settings=SMALL)
    return paths


def numpy_forecast(mart, label, future):
    """Minimum-norm least squares on standardised features."""
    train = with_month_index(mart).select(*LINEAR_FEATURES, label).toPandas().astype(float)
    x, y = train[list(LINEAR_FEATURES)].to_numpy(), train[label].to_numpy()
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1.0
    weights = np.linalg.lstsq((x - mean) / std, y - y.mean(), rcond=1e-10)[0]
    ahead = future.orderBy("Month").select(*LINEAR_FEATURES).toPandas().astype(float).to_numpy()
    return (ahead - mean) / std @ weights + y.mean()


@pytest.mark.parametrize(
    ("kind", "label", "forecast", "output"),
    [
        ("sales", "TotalSales", tc.forecast_sales, "PredictedSales"),
        ("demand", "TotalQty", tc.forecast_demand, "PredictedDemand"),
    ],
)
def test_least_squares_against_numpy(
    spark, retail, marts, models, kind, label, forecast, output
):
    got = forecast(retail, models[kind], 2002, mart=marts[kind]).orderBy("Month").collect()
    assert [(r["Year"], r["Month"], r["Quarter"]) for r in got] == [
        (2002, m, (m - 1) // 3 + 1) for m in range(1, 13)
    ]
    months = list(range(1, 13))
    future = future_from_profile(month_spine(spark, 2002, months), marts[kind], 1995, months)
    expected = numpy_forecast(marts[kind], label, future)
    assert [r[output] for r in got] == pytest.approx(list(expected), rel=0, abs=0.00501)


def monthly_star(make_star, months, holiday=0):
    """One day per month with a varying number of lines."""
    dates = [(y * 10000 + m * 100 + 1, y, m, (m - 1) // 3 + 1, holiday) for y, m in months]
    lines = [
        line(
            order=100 * i + j,
            day=d[0],
            ship=d[0] + (i * j) % 9,
            customer=j % (i % 3 + 1),
            quantity=i + j,
            price=float(7 * i + j * j),
            discount=(i * j % 5) / 20,
            total=f"{13 * i * i + j}.0000",
        )
        for i, d in enumerate(dates)
        for j in range(i % 4 + 1)
    ]
    return make_star(lines, dates)


@pytest.mark.parametrize(
    "months",
    [
        [(2020, m) for m in range(1, 13)],
        [(2020, m) for m in range(1, 5)],
        [(2020, 6)],
        [(y, m) for y in (2019, 2020) for m in range(1, 13)],
    ],
    ids=["one year", "fewer months than features", "one month", "two years"],
)
def test_dependent_features_give_the_minimum_norm_fit(spark, make_star, tmp_path, months):
    """No holiday varies here; with one year, year is constant as well."""
    star = monthly_star(make_star, months)
    tc.train_sales(star, str(tmp_path))
    asked = months[0][1]
    got = tc.forecast_sales(star, str(tmp_path), 2023, month=asked).first()["PredictedSales"]
    mart = tc.monthly_sales(star)
    future = future_from_profile(month_spine(spark, 2023, [asked]), mart, months[0][0], [asked])
    assert got == pytest.approx(numpy_forecast(mart, "TotalSales", future)[0], rel=1e-6, abs=0.02)


def test_one_month(retail, marts, models):
    every = tc.forecast_sales(retail, models["sales"], 2002, mart=marts["sales"])
    one = tc.forecast_sales(retail, models["sales"], 2002, month=7, mart=marts["sales"])
    assert rows(one) == rows(every.filter("Month = 7"))


def test_year_arguments(retail, marts, models):
    with pytest.raises(ValueError, match="year"):
        tc.forecast_sales(retail, models["sales"], None)
    for year in (None, 0):
        with pytest.raises(ValueError, match="year"):
            tc.forecast_regional(retail, models["regional"], year)
        got = tc.forecast_demand(retail, models["demand"], year, mart=marts["demand"])
        assert {r["Year"] for r in got.collect()} == {2001}
    default = tc.forecast_sales_forest(retail, models["forest"], mart=marts["sales"])
    assert {r["Year"] for r in default.collect()} == {2025}


@pytest.mark.parametrize("month", [0, 13])
def test_impossible_month(retail, marts, models, month):
    for call in (
        lambda: tc.forecast_sales(retail, models["sales"], 2002, month),
        lambda: tc.forecast_demand(retail, models["demand"], 2002, month, mart=marts["demand"]),
        lambda: tc.forecast_sales_forest(retail, models["forest"], 2002, month),
        lambda: tc.forecast_regional(retail, models["regional"], 2002, month),
    ):
        with pytest.raises(ValueError, match="month"):
            call()
    with pytest.raises(ValueError, match="month"):
        tc.score_customers(retail, models["customer"], month=13)


def test_untrained_models(retail, models, tmp_path):
    nowhere = str(tmp_path / "nothing")
    for call in (
        lambda: tc.forecast_sales(retail, nowhere, 2002),
        lambda: tc.forecast_demand(retail, nowhere, 2002),
        lambda: tc.forecast_sales_forest(retail, nowhere),
        lambda: tc.forecast_regional(retail, nowhere, 2002),
        lambda: tc.score_customers(retail, nowhere),
        # A model of another kind is not taken instead.
        lambda: tc.forecast_demand(retail, models["sales"], 2002),
    ):
        with pytest.raises(tc.ModelNotTrained):
            call()


def test_unfinished_training_run_is_ignored(retail, marts, tmp_path):
    path = str(tmp_path)
    first = tc.train_sales(retail, path, mart=marts["sales"])
    (tmp_path / "99990101T000000000000-unfinished" / "pipeline").mkdir(parents=True)
    expected = rows(tc.forecast_sales(retail, path, 2002, mart=marts["sales"]))
    second = tc.train_sales(retail, path, mart=marts["sales"])
    assert second > first
    assert rows(tc.forecast_sales(retail, path, 2002, mart=marts["sales"])) == expected


def test_stored_model_holds_scaler_categories_and_columns(spark, models):
    path = f"{models['customer']}/*"
    scaler = rows(spark.read.parquet(f"{path}/scaler"), "column")
    assert scaler == [("Month",), ("TotalQuantity",), ("TotalSpent",), ("Year",)]
    words = spark.read.parquet(f"{path}/vocabulary")
    assert rows(words.filter("column = 'EmailPromotion'"), "position", "value") == [
        (0, "0"),
        (1, "1"),
        (2, "2"),
    ]
    manifest = spark.read.parquet(f"{path}/manifest").first()
    features = manifest["features"]
    assert features[:5] == ["Year", "Month", "TotalSpent", "TotalQuantity", "PurchaseCount"]
    assert "Gender_BUILDING" in features and "Gender_AUTOMOBILE" not in features
    assert "EmailPromotion_1" in features and "EmailPromotion_0" not in features


def test_training_from_the_star_clears_its_tables(retail, spark, tmp_path):
    root = Path(scratch_root(spark)) / "tillcast"
    before = set(root.iterdir())
    tc.train_regional(retail, str(tmp_path), settings=SMALL)
    assert set(root.iterdir()) == before
    assert tc.forecast_regional(retail, str(tmp_path), 2002, month=1, territory="ASIA").count() == 1


def test_forecasts_from_the_star_clear_their_tables(retail, models, spark):
    root = Path(scratch_root(spark)) / "tillcast"
    before = set(root.iterdir())
    regional = tc.forecast_regional(retail, models["regional"], 2002)
    demand = tc.forecast_demand(retail, models["demand"])
    assert set(root.iterdir()) == before
    assert regional.count() == 60 and demand.count() == 12


def test_base_year_is_the_fitted_one(spark, retail, marts, models):
    """An earlier backfill does not shift the month index of a trained model."""
    history = marts["sales"]
    backfill = history.limit(1).withColumn("Year", F.lit(1980)).withColumn("Month", F.lit(1))
    before = tc.forecast_sales(retail, models["sales"], 2002, month=7, mart=history)
    after = tc.forecast_sales(
        retail, models["sales"], 2002, month=7, mart=history.union(backfill)
    )
    assert rows(before) == rows(after)


def test_month_without_history(make_star, tmp_path):
    star = monthly_star(make_star, [(y, m) for y in (2019, 2020) for m in range(1, 13) if m != 7])
    path = str(tmp_path)
    tc.train_sales(star, path)
    with pytest.raises(PySparkException, match="no history for month 7"):
        tc.forecast_sales(star, path, 2021).collect()
    got = tc.forecast_sales(star, path, 2021, allow_missing=True).orderBy("Month").collect()
    assert [r["PredictedSales"] is None for r in got] == [m == 7 for m in range(1, 13)]


def test_empty_history_cannot_be_fitted(make_star, tmp_path):
    star = make_star([line(day=20991231)])
    with pytest.raises(tc.UntrainableData):
        tc.train_sales(star, str(tmp_path))


def test_sales_forest_stays_within_the_history(retail, marts, models):
    got = tc.forecast_sales_forest(retail, models["forest"], 2002, mart=marts["sales"])
    values = [r[0] for r in rows(got, "PredictedSales")]
    low, high = marts["sales"].agg(F.min("TotalSales"), F.max("TotalSales")).first()
    assert len(values) == 12
    assert all(low <= v <= high for v in values)


@pytest.mark.parametrize("many", [1, 4, 9])
def test_a_forest_follows_from_its_rows(spark, retail, marts, models, tmp_path, many):
    """However the mart is cut and ordered, and whether groups of trees grow side by side."""
    mart = marts["regional"].orderBy(F.rand(many)).repartition(many)
    tc.train_regional(retail, str(tmp_path), mart=mart, settings=GROUPED)
    got = tc.forecast_regional(retail, str(tmp_path), 2002, mart=marts["regional"])
    again = str(tmp_path / "again")
    tc.train_regional(retail, again, mart=marts["regional"], settings=GROUPED)
    assert rows(got) == rows(tc.forecast_regional(retail, again, 2002, mart=marts["regional"]))
    manifest = spark.read.parquet(f"{tmp_path}/2*/manifest").first()
    assert manifest["settings"]["parts"] == "1" and manifest["settings"]["groups"] == "3"


def test_groups_of_trees_are_one_forest(spark, retail, marts, tmp_path):
    """Without bootstrap all trees are equal, so groups of any size predict the same."""
    found = []
    for groups in (1, 2, 3):
        path = str(tmp_path / str(groups))
        settings = ForestSettings(trees=5, depth=4, bins=512, bootstrap=False, groups=groups)
        tc.train_regional(retail, path, mart=marts["regional"], settings=settings)
        found.append(rows(tc.forecast_regional(retail, path, 2002, mart=marts["regional"])))
    assert found[0] == found[1] == found[2]


def test_parts_follow_the_rows():
    settings = ForestSettings(trees=1, depth=1, bins=2)
    assert [settings.parts(n) for n in (0, 1, 4096, 4097, 138_000)] == [1, 1, 1, 2, 34]
    assert 1024 < settings.parts(10**9) < 4096


def test_customer_forests_are_grouped_over_few_wide_parts():
    """Work and shuffle of a level go with nodes times parts; both grew with the rows."""
    rows = [4097, 65_536, 138_000, 830_000, 8_300_000]
    assert [CUSTOMER_FOREST.parts(n) for n in rows] == [2, 16, 1, 4, 32]
    assert [len(CUSTOMER_FOREST.shares(n)) for n in rows] == [1, 1, 8, 8, 8]
    assert sum(CUSTOMER_FOREST.shares(138_000)) == CUSTOMER_FOREST.trees
    exact = ForestSettings(trees=2, depth=5, bins=2, bootstrap=False)
    assert [exact.parts(n) for n in (0, 4097, 830_000, 8_300_000)] == [1, 2, 24, 32]


def test_groups_of_customer_trees_are_one_forest(retail, marts, tmp_path):
    """Without bootstrap all trees are equal, so groups and parts of any size score the same."""
    found = []
    for groups, per_part in ((1, 4096), (3, 4096), (3, 50)):
        path = str(tmp_path / f"{groups}-{per_part}")
        settings = ForestSettings(
            trees=5, depth=4, bins=512, bootstrap=False, groups=groups, rows_per_part=per_part
        )
        tc.train_customer(retail, path, mart=marts["customer"], settings=settings)
        scored = tc.score_customers(retail, path, mart=marts["customer"])
        found.append(rows(scored.withColumn("PurchaseProbability", F.round("PurchaseProbability", 9))))
    assert found[0] == found[1] == found[2]


def test_regional_forecast(retail, marts, models):
    got = tc.forecast_regional(retail, models["regional"], 2002, mart=marts["regional"])
    names = {r[0] for r in rows(marts["regional"], "TerritoryName")}
    assert rows(got, "TerritoryName", "Month") == sorted(
        ((n, m) for n in names for m in range(1, 13)), key=repr
    )
    low, high = marts["regional"].agg(F.min("TotalSales"), F.max("TotalSales")).first()
    assert all(low <= r[0] <= high for r in rows(got, "PredictedSales"))
    one = tc.forecast_regional(
        retail, models["regional"], 2002, territory="EUROPE", mart=marts["regional"]
    )
    assert rows(one) == rows(got.filter("TerritoryName = 'EUROPE'"))


def test_unknown_territory_gets_the_base_level(retail, marts, models):
    def forecast(name):
        frame = tc.forecast_regional(
            retail, models["regional"], 2002, territory=name, mart=marts["regional"]
        )
        return rows(frame, "Month", "PredictedSales")

    assert forecast("Atlantis") == forecast("AFRICA")


def test_regional_month_without_history(retail, marts, models):
    history = marts["regional"].filter("Month != 2")
    with pytest.raises(PySparkException, match="no history for month 2"):
        tc.forecast_regional(retail, models["regional"], 2002, mart=history).collect()
    got = tc.forecast_regional(
        retail, models["regional"], 2002, mart=history, allow_missing=True
    )
    missing = got.filter("PredictedSales is null")
    assert {r["Month"] for r in missing.collect()} == {2}
    assert got.count() == 60


def test_customer_scores(retail, marts, models):
    scored = tc.score_customers(retail, models["customer"], mart=marts["customer"]).cache()
    customers = marts["customer"].select("CustomerKey").distinct().count()
    assert scored.count() == customers == scored.select("CustomerKey").distinct().count()
    assert scored.filter("PurchaseProbability < 0 or PurchaseProbability > 1").count() == 0
    assert scored.filter("Prediction != cast(PurchaseProbability > 0.5 as int)").count() == 0
    latest = marts["customer"].groupBy("CustomerKey").agg(F.max(F.struct("Year", "Month")).alias("d"))
    assert rows(scored, "CustomerKey", "Year", "Month") == rows(
        latest, "CustomerKey", "d.Year", "d.Month"
    )
    top = tc.score_customers(retail, models["customer"], mart=marts["customer"], top_n=5).collect()
    best = sorted((-r["PurchaseProbability"], r["CustomerKey"]) for r in scored.collect())[:5]
    assert [(-r["PurchaseProbability"], r["CustomerKey"]) for r in top] == best


def test_customer_scores_follow_the_base_rate(retail, marts, models):
    """Over all customer-months, each taken as a customer of its own."""
    rate = next_purchase_label(marts["customer"]).agg(F.avg("NextPurchase")).first()[0]
    single = marts["customer"].withColumn("CustomerKey", F.monotonically_increasing_id())
    scored = tc.score_customers(retail, models["customer"], mart=single)
    assert scored.count() == marts["customer"].count()
    assert abs(scored.agg(F.avg("PurchaseProbability")).first()[0] - rate) < 0.01


@pytest.mark.parametrize(("year", "month"), [(2000, None), (None, 3), (2000, 3), (0, 0)])
def test_customer_filters_from_star_and_from_stored_mart(retail, marts, models, year, month):
    from_star = tc.score_customers(retail, models["customer"], year, month)
    from_mart = tc.score_customers(retail, models["customer"], year, month, mart=marts["customer"])
    got = rows(from_star)
    assert got and got == rows(from_mart)
    assert {r[1] for r in got} == {2000} or not year
    assert {r[2] for r in got} == {3} or not month


def test_one_label_class_cannot_be_fitted(make_star, tmp_path):
    star = make_star([line(1, customer=1), line(2, customer=2)])
    with pytest.raises(tc.UntrainableData):
        tc.train_customer(star, str(tmp_path))


def test_probability_of_one_half_predicts_zero(spark):
    frame = spark.createDataFrame([(0.5,), (0.5000001,), (0.4,)], "p double")
    assert rows(frame.select("p", above_half(F.col("p")).alias("x"))) == [
        (0.4, 0),
        (0.5, 0),
        (0.5000001, 1),
    ]


def test_jobs_leave_the_mart_choice_free(retail, marts, models):
    """The same forecast from the star and from the stored mart."""
    stored = tc.forecast_regional(retail, models["regional"], 2002, mart=marts["regional"])
    assert rows(tc.forecast_regional(retail, models["regional"], 2002)) == rows(stored)


WIDE = ForestSettings(trees=6, depth=6, bins=32, groups=2, wide_from=100, subset="sqrt")


def test_a_wide_customer_forest_is_a_table_of_nodes(retail, marts, spark, tmp_path):
    """No tree reaches the driver, and the scores hold what those of any forest do."""
    mart = marts["customer"]
    path = str(tmp_path / "model")
    root = Path(scratch_root(spark)) / "tillcast"
    before = set(root.iterdir())
    version = tc.train_customer(retail, path, mart=mart, settings=WIDE)
    assert set(root.iterdir()) == before
    held = {p.name for p in Path(path, version).iterdir()}
    assert held == {"trees", "bins", "scaler", "vocabulary", "manifest"}
    nodes = spark.read.parquet(f"{path}/{version}/trees")
    assert nodes.select("tree").distinct().count() == WIDE.trees
    assert nodes.agg(F.max("node")).first()[0] < 2 ** (WIDE.depth + 1)
    rate = next_purchase_label(mart).agg(F.avg("NextPurchase")).first()[0]
    single = mart.withColumn("CustomerKey", F.monotonically_increasing_id())
    scored = tc.score_customers(retail, path, mart=single)
    assert scored.count() == mart.count()
    assert abs(scored.agg(F.avg("PurchaseProbability")).first()[0] - rate) < 0.02
    assert scored.filter("PurchaseProbability < 0 or PurchaseProbability > 1").count() == 0
    # In as many slices as there are, and as the best of all customers.
    model = load_model(spark, path, "customer")
    assert model.predictor.slices == 1
    scores = rows(tc.score_customers(retail, path, mart=mart))
    top = tc.score_customers(retail, path, mart=mart, top_n=5).collect()
    assert [tuple(r) for r in top] == sorted(scores, key=lambda r: (-r[3], r[0]))[:5]


def test_wide_forests_are_those_of_mllib(retail, marts, tmp_path, monkeypatch):
    """Without draws: however many rows meet in a task, the same trees as MLlib grows."""
    found = []
    for wide, node_rows in ((None, 1 << 22), (100, 1 << 22), (100, 200)):
        monkeypatch.setattr(wide_forest, "NODE_ROWS", node_rows)
        path = str(tmp_path / f"{wide}-{node_rows}")
        settings = ForestSettings(
            trees=2, depth=5, bins=20_000, bootstrap=False, groups=2, wide_from=wide
        )
        tc.train_customer(retail, path, mart=marts["customer"], settings=settings)
        scored = tc.score_customers(retail, path, mart=marts["customer"])
        found.append(rows(scored.withColumn("PurchaseProbability", F.round("PurchaseProbability", 9))))
    assert found[0] == found[1] == found[2]


def test_the_larger_child_has_what_is_left_of_its_parent(spark):
    """Only the smaller child's rows are counted; both children split as if counted themselves."""
    source = np.random.default_rng(3)
    codes = source.integers(0, [12, 32, 3], (3000, 3)).astype(np.uint8)
    label = (source.random(3000) < codes[:, 1] / 32).astype(np.uint8)
    bins = wide_forest.Bins({"a": [float(i) for i in range(11)], "b": [float(i) for i in range(31)]}, "v", [2])
    growth = wide_forest.Growth(bins.widths, 2, 4, 12, 1, False)
    chunk = (0, 0, len(codes), codes.tobytes(), label.tobytes())
    rows_ = spark.createDataFrame([chunk], "part int, chunk int, rows int, codes binary, label binary")
    tops = {0: {1: (0, 2)}}
    root = wide_forest._split_tops(rows_, bins, growth, {0: {}}, {(0, 1): wide_forest.Counted((1,))})
    parent = bytes(root[0]["cells"])
    own = [
        wide_forest._split_tops(rows_, bins, growth, tops, {(0, n): wide_forest.Counted((n,))})[0]
        for n in (2, 3)
    ]
    both = wide_forest._split_tops(
        rows_, bins, growth, tops, {(0, 2): wide_forest.Counted((2, 3), parent)}
    )
    assert sorted(both, key=lambda r: r["node"]) == own
    assert all(r["split"] >= 0 for r in own)


def test_a_wide_forest_follows_from_its_rows(retail, marts, tmp_path, monkeypatch):
    """However the mart is cut and ordered, with nodes split over all parts."""
    monkeypatch.setattr(wide_forest, "NODE_ROWS", 400)
    found = []
    for mart in (marts["customer"], marts["customer"].orderBy(F.rand(5)).repartition(5)):
        path = str(tmp_path / str(len(found)))
        tc.train_customer(retail, path, mart=mart, settings=WIDE)
        found.append(rows(tc.score_customers(retail, path, mart=marts["customer"])))
    assert found[0] == found[1]


def test_a_node_without_histogram_of_its_parent_grows_the_same(monkeypatch):
    """Histograms of too many nodes for one table are made in steps."""
    source = np.random.default_rng(7)
    codes = source.integers(0, [12, 32, 3], (4000, 3)).astype(np.uint8)
    label = (source.random(4000) < codes[:, 1] / 32).astype(np.uint8)
    growth = wide_forest.Growth([12, 32, 3], 2, 4, 12, 1, True)
    draws = growth.draws(0, 0, 0, 4000)
    found = []
    for cells in (1 << 23, 47 * 8, 47):
        monkeypatch.setattr(wide_forest, "CELLS", cells)
        nodes = wide_forest.grown(growth, codes, draws, label, 1, 0)
        ids, split, _, good, total = nodes
        assert good[0] == (draws * label).sum() and total[0] == draws.sum()
        leaf = split < 0
        assert good[leaf].sum() == good[0] and total[leaf].sum() == total[0]
        found.append([sorted(zip(*[a.tolist() for a in nodes], strict=True))])
    # Nodes draw their features in one order whatever the steps.
    assert found[0] == found[1] == found[2]


def test_a_wide_forest_refuses_what_is_not_a_number(retail, marts, tmp_path):
    mart = marts["customer"].withColumn(
        "TotalQuantity", F.when(F.col("CustomerKey") % 7 > 0, F.col("TotalQuantity"))
    )
    with pytest.raises(PySparkException, match="TotalQuantity is NULL or NaN"):
        tc.train_customer(retail, str(tmp_path), mart=mart, settings=WIDE)


def test_a_lost_table_of_nodes_is_an_error(retail, marts, tmp_path):
    version = tc.train_customer(retail, str(tmp_path), mart=marts["customer"], settings=WIDE)
    (tmp_path / version / "trees").rename(tmp_path / "elsewhere")
    with pytest.raises(tc.ModelNotTrained):
        tc.score_customers(retail, str(tmp_path), mart=marts["customer"])

"""The ten jobs: a trainer and a scorer for each of the five models.

Every job takes the star and builds the mart it needs, or takes the mart as ``mart=``
when one is stored, which saves the pass over the fact table: it is then read several
times as it is. Trainers run at once and return the name of the model version written.
Scorers return a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.errors import UntrainableData
from tillcast.operators.calendar import chosen_months, month_spine, with_month_index, year_bounds
from tillcast.operators.customers import latest_month, next_purchase_label
from tillcast.operators.encoding import INDICATORS, align_columns, indicator_blocks
from tillcast.operators.marts import (
    CUSTOMER_TRAITS,
    DRIVERS,
    customer_monthly,
    customer_months,
    monthly_demand,
    monthly_sales,
    regional_monthly,
    with_traits,
)
from tillcast.operators.profiles import attach_profile, future_from_means, future_from_profile
from tillcast.operators.scaling import Scaler
from tillcast.operators.split import holdout_split
from tillcast.operators.territories import territory_month_spine
from tillcast.plans.artefacts import TrainedModel, load_model, save_model
from tillcast.plans.features import (
    CUSTOMER_CATEGORIES,
    CUSTOMER_NUMBERS,
    CUSTOMER_SCALED,
    FOREST_FEATURES,
    LINEAR_FEATURES,
    customer_columns,
    mart_facts,
    regional_columns,
)
from tillcast.plans.models import (
    CUSTOMER_FOREST,
    REGRESSION_FOREST,
    SEED,
    ForestSettings,
    above_half,
    fit_forest_classification,
    fit_forest_regression,
    fit_least_squares,
    positive_probability,
    rounded_prediction,
)
from tillcast.plans.wide_forest import fit_wide_forest
from tillcast.sources.star import StarSchema
from tillcast.staging import scratch_folder, staged


def train_sales(star: StarSchema, path: str, mart: DataFrame | None = None) -> str:
    """Fit monthly sales (money) by least squares."""
    with _history(mart, lambda: monthly_sales(star), "monthly_sales") as history:
        return _train_linear("sales", history, "TotalSales", path)


def forecast_sales(
    star: StarSchema,
    path: str,
    year: int,
    month: int | None = None,
    mart: DataFrame | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """Year, Month, Quarter, PredictedSales for a year, or for one of its months."""
    if year is None:
        raise ValueError("year is required")
    history = mart or monthly_sales(star)
    return _forecast_linear("sales", history, path, year, month, allow_missing).withColumnRenamed(
        "Predicted", "PredictedSales"
    )


def train_demand(star: StarSchema, path: str, mart: DataFrame | None = None) -> str:
    """Fit monthly demand (units) by least squares."""
    with _history(mart, lambda: monthly_demand(star), "monthly_demand") as history:
        return _train_linear("demand", history, "TotalQty", path)


def forecast_demand(
    star: StarSchema,
    path: str,
    year: int | None = None,
    month: int | None = None,
    mart: DataFrame | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """Year, Month, Quarter, PredictedDemand; the year defaults to the last in the history."""

    def forecast(history: DataFrame, year: int) -> DataFrame:
        found = _forecast_linear("demand", history, path, year, month, allow_missing)
        return found.withColumnRenamed("Predicted", "PredictedDemand")

    history = mart or monthly_demand(star)
    if year:
        return forecast(history, year)
    if mart is not None:
        return forecast(mart, year_bounds(mart).first()["MaxYear"])
    # Needed twice, for the last year and for the profile: aggregate the fact once.
    with staged(history, "monthly_demand") as built:
        return _held(forecast(built, year_bounds(built).first()["MaxYear"]))


def train_sales_forest(
    star: StarSchema,
    path: str,
    mart: DataFrame | None = None,
    settings: ForestSettings = REGRESSION_FOREST,
) -> str:
    """Fit monthly sales by a forest on four fifths of the months."""
    with _history(mart, lambda: monthly_sales(star), "monthly_sales") as history:
        keys = ["Year", "Month", "Quarter", "IsHolidaySL"]
        train, _ = holdout_split(history, keys)
        rows = train.count()
        if not rows:
            raise UntrainableData("the history has no month in the training part")
        pipeline = fit_forest_regression(train, FOREST_FEATURES, "TotalSales", settings, keys, rows)
        model = TrainedModel(
            "sales_forest", pipeline, list(FOREST_FEATURES), settings=settings.told(rows)
        )
        return save_model(history.sparkSession, path, model)


def forecast_sales_forest(
    star: StarSchema,
    path: str,
    year: int = 2025,
    month: int | None = None,
    mart: DataFrame | None = None,
) -> DataFrame:
    """Year, Month, Quarter, PredictedSales; every month gets the same global means."""
    months = chosen_months(month)
    history = mart or monthly_sales(star)
    model = load_model(history.sparkSession, path, "sales_forest")
    future = future_from_means(history, year, months)
    return model.predictor.transform(future).select(
        "Year", "Month", "Quarter", rounded_prediction().alias("PredictedSales")
    )


def train_regional(
    star: StarSchema,
    path: str,
    mart: DataFrame | None = None,
    settings: ForestSettings = REGRESSION_FOREST,
) -> str:
    """Fit units by territory and month with a forest."""
    with _history(mart, lambda: regional_monthly(star), "regional_monthly") as history:
        facts = mart_facts(history, ["TerritoryName"])
        if facts.first_year is None:
            raise UntrainableData("the history is empty")
        rows = history.count()
        encoded = regional_columns(history, facts.categories, facts.first_year)
        keys = ["TerritoryName", "Year", "Month"]
        pipeline = fit_forest_regression(
            encoded.frame, encoded.columns, "TotalSales", settings, keys, rows
        )
        model = TrainedModel(
            "regional",
            pipeline,
            encoded.features,
            facts.first_year,
            categories=facts.categories,
            settings=settings.told(rows),
        )
        return save_model(history.sparkSession, path, model)


def forecast_regional(
    star: StarSchema,
    path: str,
    year: int,
    month: int | None = None,
    territory: str | None = None,
    mart: DataFrame | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """TerritoryName, Year, Month, PredictedSales (units) for all territories or one.

    All territories share one month profile, taken over every territory's history.
    """
    if not year:
        raise ValueError("year is required")
    months = chosen_months(month)
    model = load_model(star.fact.sparkSession if mart is None else mart.sparkSession, path, "regional")

    def forecast(history: DataFrame) -> DataFrame:
        spine = territory_month_spine(history, year, months, territory)
        future = attach_profile(spine, history, months, allow_missing)
        encoded = regional_columns(future, model.categories, model.base_year)
        keys = ["TerritoryName", "Year", "Month"]
        return _predict(model, encoded.frame, keys, allow_missing).select(
            *keys, rounded_prediction().alias("PredictedSales")
        )

    if mart is not None or territory:
        return forecast(mart or regional_monthly(star))
    # Needed twice, for the names and for the profile: aggregate the fact once.
    with staged(regional_monthly(star), "regional_monthly") as built:
        return _held(forecast(built))


def train_customer(
    star: StarSchema,
    path: str,
    mart: DataFrame | None = None,
    settings: ForestSettings = CUSTOMER_FOREST,
) -> str:
    """Fit whether a customer buys again, with a forest on customer-months."""
    labelled = next_purchase_label(mart or customer_monthly(star))
    spark = labelled.sparkSession
    with staged(labelled, "customer_monthly") as history, scratch_folder(spark, "forest") as folder:
        labels = history.agg(
            F.min("NextPurchase").alias("lowest"),
            F.max("NextPurchase").alias("highest"),
            F.count("*").alias("rows"),
        ).first()
        if labels["lowest"] == labels["highest"]:
            raise UntrainableData("the history needs customers with and without a later purchase")
        facts = mart_facts(history, CUSTOMER_TRAITS)
        encoded = customer_columns(history, facts.categories)
        scaler = Scaler.fit(history, CUSTOMER_SCALED)
        scaled = scaler.transform(encoded.frame.withColumns(_kept_keys()))
        how = settings, list(_kept_keys()), labels["rows"]
        if settings.wide(labels["rows"]):
            blocks = indicator_blocks(facts.categories, CUSTOMER_CATEGORIES)
            predictor = fit_wide_forest(
                scaled, CUSTOMER_NUMBERS, INDICATORS, blocks, "NextPurchase", *how, SEED, folder
            )
        else:
            predictor = fit_forest_classification(scaled, encoded.columns, "NextPurchase", *how)
        model = TrainedModel(
            "customer",
            predictor,
            encoded.features,
            scaler=scaler,
            categories=facts.categories,
            settings=settings.told(labels["rows"]),
        )
        return save_model(history.sparkSession, path, model)


def score_customers(
    star: StarSchema,
    path: str,
    year: int | None = None,
    month: int | None = None,
    top_n: int | None = None,
    mart: DataFrame | None = None,
) -> DataFrame:
    """CustomerKey, Year, Month, PurchaseProbability, Prediction: each customer's last month.

    Year and month are filtered before anything else. The last month is picked before the
    customers' traits are joined, so one row a customer meets them. All customers come back unless ``top_n`` asks for the most
    likely ones. Unlike in the forecasts, a month of 0 means every month here.
    """
    if month:
        chosen_months(month)
    if mart is None:
        latest = with_traits(star, latest_month(customer_months(star, year, month)))
    else:
        if year:
            mart = mart.filter(F.col("Year") == year)
        if month:
            mart = mart.filter(F.col("Month") == month)
        latest = mart
    model = load_model(latest.sparkSession, path, "customer")
    # A customer listed more than once has a row for each listing.
    encoded = customer_columns(latest_month(latest), model.categories)
    keys = ["CustomerKey", "Year", "Month"]
    scored = (
        _predict(model, encoded.frame, keys)
        .select(*keys, positive_probability(model.predictor).alias("PurchaseProbability"))
        .withColumn("Prediction", above_half(F.col("PurchaseProbability")))
    )
    if top_n is None:
        return scored
    return scored.orderBy(F.desc("PurchaseProbability"), "CustomerKey").limit(top_n)


def _held(forecast: DataFrame) -> DataFrame:
    """A forecast's rows, which outlive the table they were read from: up to twelve, or twelve
    for each territory."""
    return forecast.sparkSession.createDataFrame(forecast.collect(), forecast.schema)


def _kept_keys() -> dict[str, Column]:
    """The key of a customer's month, which scaling leaves as it is."""
    return {f"key_{c}": F.col(c) for c in ("CustomerKey", "Year", "Month")}


@contextmanager
def _history(
    mart: DataFrame | None, build: Callable[[], DataFrame], label: str
) -> Iterator[DataFrame]:
    """The stored mart, or one built and staged for the time of the training."""
    if mart is not None:
        yield mart
    else:
        with staged(build(), label) as built:
            yield built


def _train_linear(kind: str, history: DataFrame, label: str, path: str) -> str:
    base_year = year_bounds(history).first()["MinYear"]
    if base_year is None:
        raise UntrainableData("the history is empty")
    dated = with_month_index(history, base_year)
    scaler, weights = fit_least_squares(dated, LINEAR_FEATURES, label)
    model = TrainedModel(kind, weights, list(LINEAR_FEATURES), base_year, scaler)
    return save_model(history.sparkSession, path, model)


def _forecast_linear(
    kind: str, history: DataFrame, path: str, year: int, month: int | None, allow_missing: bool
) -> DataFrame:
    months = chosen_months(month)
    spark: SparkSession = history.sparkSession
    model = load_model(spark, path, kind)
    future = future_from_profile(
        month_spine(spark, year, months), history, model.base_year, months, allow_missing
    )
    keys = ["Year", "Month", "Quarter"]
    return _predict(model, future, keys, allow_missing).select(
        *keys, rounded_prediction().alias("Predicted")
    )


def _predict(
    model: TrainedModel, frame: DataFrame, keys: list[str], allow_missing: bool = False
) -> DataFrame:
    """Scale, align to the fitted columns and predict all rows in one pass.

    The key columns are carried along untouched. With ``allow_missing`` a row without
    a profile gets a NULL prediction.
    """
    carried = frame.select("*", *[F.col(k).alias(f"key_{k}") for k in keys])
    rows = align_columns(
        model.scaler.transform(carried), model.columns, [f"key_{k}" for k in keys]
    )
    if allow_missing:
        known = reduce(and_, [F.col(c).isNotNull() for c in DRIVERS])
        rows = rows.withColumn("known", known).fillna(0.0, subset=list(DRIVERS))
    predicted = model.predictor.transform(rows)
    if allow_missing:
        predicted = predicted.withColumn(
            "prediction", F.when(F.col("known"), F.col("prediction"))
        )
    return predicted.drop(*[k for k in keys if k in model.columns]).withColumnsRenamed(
        {f"key_{k}": k for k in keys}
    )

"""One query per operator and job, each over whole tables.

Averages of doubles are rounded where two engines may add in a different order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tillcast as tc
from tillcast.functions import (
    date_from_key,
    quarter_of_month,
    shipping_days,
    truncated_mean,
    two_decimals,
    zero_if_null,
)
from tillcast.operators.calendar import chosen_months, month_spine, with_month_index, year_bounds
from tillcast.operators.customers import latest_month, next_purchase_label
from tillcast.operators.encoding import align_columns, category_vocabulary
from tillcast.operators.marts import CUSTOMER_TRAITS, DRIVERS
from tillcast.operators.profiles import (
    attach_profile,
    future_from_means,
    future_from_profile,
    global_means,
    month_profile,
)
from tillcast.operators.scaling import Scaler
from tillcast.operators.split import hash_bucket, in_training_part
from tillcast.operators.territories import territory_month_spine, territory_names
from tillcast.plans.features import (
    CUSTOMER_SCALED,
    LINEAR_FEATURES,
    customer_features,
    regional_features,
)
from tillcast.plans.models import ForestSettings
from tillcast.sources.star import CUSTOMERS, DATES, FACT, TERRITORIES, StarSchema
from tillcast.sources.warehouse import MARTS, conform_mart
from tillcast.staging import scratch_path, stage

# The test history ends in 2001.
YEAR = 2002
LAST_FULL_YEAR = 2000

Query = Callable[[SparkSession, str], DataFrame]

# Decimal places kept of each averaged or summed double.
PLACES = {
    "TotalSales": 4,
    "TotalSpent": 6,
    "AvgUnitPrice": 6,
    "AvgDiscount": 12,
    "TotalOrders": 6,
    "UniqueCustomers": 6,
    "AvgShippingTime": 6,
    "IsHolidaySL": 6,
}


def _rounded(df: DataFrame) -> DataFrame:
    """Round the double columns among PLACES."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(c, PLACES[c]).alias(c) if c in PLACES and kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


_stars: dict[tuple[str, str], StarSchema] = {}


def _star(spark: SparkSession, folder: str) -> StarSchema:
    """One star per session and data folder: its calendar is derived and measured once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stars:
        _stars[key] = tc.retail_star(spark, folder)
    return _stars[key]


def _over_star(build: Callable[[StarSchema], DataFrame]) -> Query:
    return lambda spark, folder: build(_star(spark, folder))


# -- star tables and scalar functions -----------------------------------------------


def fact_sales_detail(star: StarSchema) -> DataFrame:
    money = {c: F.col(c).cast("double") for c in ("LineTotal", "TotalDue")}
    return star.fact.withColumns(money)


def datekey_to_date(star: StarSchema) -> DataFrame:
    return star.fact.select(
        "SalesOrderID",
        "OrderDateKey",
        "ShipDateKey",
        date_from_key(F.col("OrderDateKey")).alias("OrderDate"),
        date_from_key(F.col("ShipDateKey")).alias("ShipDate"),
    )


def _days() -> Column:
    return shipping_days(F.col("OrderDateKey"), F.col("ShipDateKey"))


def shipping_days_query(star: StarSchema) -> DataFrame:
    return star.fact.select(
        "SalesOrderID", "OrderDateKey", "ShipDateKey", _days().alias("ShippingDays")
    )


def quarter_of_month_query(star: StarSchema) -> DataFrame:
    return star.dates.select("DateKey", "Month", quarter_of_month(F.col("Month")).alias("Quarter"))


def null_default_columns(star: StarSchema) -> DataFrame:
    return star.dates.select(
        "DateKey",
        zero_if_null(F.col("Quarter")).alias("Quarter"),
        zero_if_null(F.col("IsHolidaySL")).alias("IsHolidaySL"),
    )


def two_decimals_query(star: StarSchema) -> DataFrame:
    return tc.regional_monthly(star).select(
        "TerritoryName", "Year", "Month", two_decimals(F.col("AvgUnitPrice")).alias("AvgUnitPrice")
    )


# -- joins and aggregates -------------------------------------------------------------


def join_fact_date(star: StarSchema) -> DataFrame:
    return star.dated_lines().select(
        "SalesOrderID", "OrderDateKey", "Year", "Month", "Quarter", "IsHolidaySL", "OrderQty"
    )


def join_fact_territory(star: StarSchema) -> DataFrame:
    return star.territory_lines().select("SalesOrderID", "TerritoryName", "Year", "Month", "OrderQty")


def join_fact_customer(star: StarSchema) -> DataFrame:
    return star.fact.join(star.customers, "CustomerKey").select(
        "SalesOrderID", "CustomerKey", *CUSTOMER_TRAITS, "OrderQty"
    )


def distinct_orders_customers(star: StarSchema) -> DataFrame:
    return (
        star.dated_lines()
        .groupBy("Year", "Month")
        .agg(
            F.countDistinct("SalesOrderID").alias("TotalOrders"),
            F.countDistinct("CustomerKey").alias("UniqueCustomers"),
        )
    )


def integer_avg_shipping(star: StarSchema) -> DataFrame:
    return (
        star.dated_lines()
        .groupBy("Year", "Month")
        .agg(truncated_mean(_days()).alias("AvgShippingTime"))
    )


def raw_group_null_default(star: StarSchema) -> DataFrame:
    return (
        star.dated_lines()
        .groupBy("Year", "Month", "Quarter", "IsHolidaySL")
        .agg(F.count("SalesOrderID").alias("Lines"))
        .select(
            "Year",
            "Month",
            zero_if_null(F.col("Quarter")).alias("Quarter"),
            zero_if_null(F.col("IsHolidaySL")).alias("IsHolidaySL"),
            "Lines",
        )
    )


# -- calendar, profiles, spines ---------------------------------------------------------


def month_index(star: StarSchema) -> DataFrame:
    return with_month_index(stage(tc.monthly_sales(star), "monthly_sales")).select(
        "Year", "Month", "Quarter", "IsHolidaySL", "MonthIndex"
    )


def _future_linear(mart: DataFrame) -> DataFrame:
    months = chosen_months(None)
    history = stage(mart, "history")
    base_year = year_bounds(history).first()["MinYear"]
    spine = month_spine(history.sparkSession, YEAR, months)
    return _rounded(future_from_profile(spine, history, base_year, months)).select(
        *LINEAR_FEATURES
    )


def future_months_sales(star: StarSchema) -> DataFrame:
    return _future_linear(tc.monthly_sales(star))


def future_months_demand(star: StarSchema) -> DataFrame:
    return _future_linear(tc.monthly_demand(star))


def future_months_forest(star: StarSchema) -> DataFrame:
    return _rounded(future_from_means(tc.monthly_sales(star), YEAR, chosen_months(None)))


def territory_month_spine_query(star: StarSchema) -> DataFrame:
    months = chosen_months(None)
    history = stage(tc.regional_monthly(star), "regional_monthly")
    spine = territory_month_spine(history, YEAR, months)
    return _rounded(attach_profile(spine, history, months)).select(
        "TerritoryName", "Year", "Month", *DRIVERS
    )


def json_records(star: StarSchema) -> DataFrame:
    spine = territory_month_spine(star.territory_lines(), YEAR, chosen_months(None))
    return tc.json_records(spine.select("TerritoryName", "Year", "Month", "Quarter"))


# -- customers ------------------------------------------------------------------------


def next_purchase(star: StarSchema) -> DataFrame:
    return next_purchase_label(tc.customer_monthly(star)).select(
        "CustomerKey", "Year", "Month", "PurchaseCount", "NextPurchase"
    )


def latest_customer_month(star: StarSchema) -> DataFrame:
    return _rounded(latest_month(tc.customer_monthly(star)))


def latest_customer_month_in_year(star: StarSchema) -> DataFrame:
    return _rounded(latest_month(tc.customer_monthly(star, LAST_FULL_YEAR)))


def latest_customer_month_in_month(star: StarSchema) -> DataFrame:
    return _rounded(latest_month(tc.customer_monthly(star, month=3)))


# -- features -------------------------------------------------------------------------


def category_vocabulary_query(star: StarSchema) -> DataFrame:
    return category_vocabulary(tc.customer_monthly(star), CUSTOMER_TRAITS)


def indicators_customer(star: StarSchema) -> DataFrame:
    encoded = customer_features(stage(tc.customer_monthly(star), "customer_monthly"))
    return encoded.as_columns().select("CustomerKey", "Year", "Month", *encoded.features[5:])


def indicators_territory(star: StarSchema) -> DataFrame:
    encoded = regional_features(stage(tc.regional_monthly(star), "regional_monthly"))
    columns = ["TerritoryName", "Year", "Month", *encoded.features[:-5]]
    return _rounded(encoded.as_columns().select(*columns))


def _rounded_all(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def scale_monthly(star: StarSchema) -> DataFrame:
    dated = with_month_index(stage(tc.monthly_sales(star), "monthly_sales"))
    scaled = Scaler.fit(dated, LINEAR_FEATURES).transform(dated)
    return _rounded_all(scaled, list(LINEAR_FEATURES)).select(
        *LINEAR_FEATURES, F.round("TotalSales", 4).alias("TotalSales")
    )


def scale_customer(star: StarSchema) -> DataFrame:
    mart = stage(tc.customer_monthly(star), "customer_monthly")
    scaled = Scaler.fit(mart, CUSTOMER_SCALED).transform(mart)
    return _rounded_all(scaled, list(CUSTOMER_SCALED)).select(
        "CustomerKey", *CUSTOMER_SCALED, "PurchaseCount"
    )


def align_columns_query(star: StarSchema) -> DataFrame:
    """Reorders, drops TotalSpent and adds an indicator the frame does not have."""
    wanted = ["PurchaseCount", "TotalQuantity", "Gender_UNHEARD_OF"]
    return align_columns(
        tc.customer_monthly(star), wanted, keep=["CustomerKey", "Year", "Month"]
    )


def holdout_split_query(star: StarSchema) -> DataFrame:
    keys = ["Year", "Month", "Quarter", "IsHolidaySL"]
    return tc.monthly_sales(star).select(
        *keys,
        hash_bucket(keys).alias("Bucket"),
        in_training_part(keys).cast("int").alias("InTraining"),
    )


# -- jobs -----------------------------------------------------------------------------

Mart = Callable[[StarSchema], DataFrame]
_ready: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}


#: Trees that see all rows and features, with a split for each value in up to as many rows as
#: there are bins: what they must be follows from the data, and the SQL grows them too.
EXACT = ForestSettings(trees=2, depth=5, bins=40_000, bootstrap=False)


def _job(
    build: Mart,
    trainer: Callable[..., str],
    score: Callable[[StarSchema, str, DataFrame], DataFrame],
    settings: ForestSettings | None = None,
) -> Query:
    """Store the mart and train on it once per session and data folder, then score.

    Training and scoring read the stored mart, so the fact table is aggregated once.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = _star(spark, folder)
        key = (spark.sparkContext.applicationId, folder, f"{trainer.__name__} {settings}")
        if key not in _ready:
            mart = stage(build(star), build.__name__)
            path = scratch_path(spark, trainer.__name__)
            trainer(star, path, mart=mart, **({"settings": settings} if settings else {}))
            _ready[key] = (mart, path)
        mart, path = _ready[key]
        return score(star, path, mart)

    return run


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of a small result with the place at which each is emitted, from 1.

    One task passes the sorted parts on one after the other.
    """
    return df.coalesce(1).withColumn("Place", F.monotonically_increasing_id() + 1)


def monthly_sales_in_order(star: StarSchema) -> DataFrame:
    order = ["Year", "Month", "Quarter", "IsHolidaySL", "TotalSales"]
    return _in_order(_rounded(tc.monthly_sales(star)).select(*order).orderBy(*order))


def json_records_mart(star: StarSchema) -> DataFrame:
    columns = ["TerritoryName", "Year", "Month", "TotalSales", "AvgUnitPrice", "AvgDiscount"]
    return tc.json_records(_rounded(tc.regional_monthly(star)).select(*columns))


def _pushed(mart: str) -> Query:
    """The aggregate that is sent to a warehouse, run by Spark over views of the star; its
    SQL is the same aggregate as generated for the other database."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = _star(spark, folder)
        names = {FACT: "pushed_fact", DATES: "pushed_dates", TERRITORIES: "pushed_territories",
                 CUSTOMERS: "pushed_customers"}
        for table, name in names.items():
            getattr(star, name.removeprefix("pushed_")).createOrReplaceTempView(name)
        sql = tc.mart_sql(mart, "spark", names)
        return _rounded(conform_mart(spark.sql(sql), mart))

    return run


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("PurchaseProbability", F.round("PurchaseProbability", 9))


QUERIES: dict[str, Query] = {
    "fact_sales_detail": _over_star(fact_sales_detail),
    "dim_date": _over_star(lambda star: star.dates),
    "dim_customer": _over_star(lambda star: star.customers),
    "dim_territory": _over_star(lambda star: star.territories),
    "datekey_to_date": _over_star(datekey_to_date),
    "shipping_days": _over_star(shipping_days_query),
    "quarter_of_month": _over_star(quarter_of_month_query),
    "null_default_columns": _over_star(null_default_columns),
    "two_decimals": _over_star(two_decimals_query),
    "monthly_sales": _over_star(lambda star: _rounded(tc.monthly_sales(star))),
    "monthly_demand": _over_star(lambda star: _rounded(tc.monthly_demand(star))),
    "regional_monthly": _over_star(lambda star: _rounded(tc.regional_monthly(star))),
    "customer_monthly": _over_star(lambda star: _rounded(tc.customer_monthly(star))),
    "join_fact_date": _over_star(join_fact_date),
    "join_fact_territory": _over_star(join_fact_territory),
    "join_fact_customer": _over_star(join_fact_customer),
    "distinct_orders_customers": _over_star(distinct_orders_customers),
    "integer_avg_shipping": _over_star(integer_avg_shipping),
    "raw_group_null_default": _over_star(raw_group_null_default),
    "month_index": _over_star(month_index),
    "year_bounds": _over_star(lambda star: year_bounds(star.dated_lines())),
    "month_profile_sales": _over_star(lambda star: _rounded(month_profile(tc.monthly_sales(star)))),
    "month_profile_demand": _over_star(
        lambda star: _rounded(month_profile(tc.monthly_demand(star)))
    ),
    "month_profile_regional": _over_star(
        lambda star: _rounded(month_profile(tc.regional_monthly(star)))
    ),
    "global_feature_means": _over_star(lambda star: _rounded(global_means(tc.monthly_sales(star)))),
    "territory_names": _over_star(lambda star: territory_names(star.territory_lines())),
    "future_months_sales": _over_star(future_months_sales),
    "future_months_demand": _over_star(future_months_demand),
    "future_months_forest": _over_star(future_months_forest),
    "territory_month_spine": _over_star(territory_month_spine_query),
    "json_records": _over_star(json_records),
    "json_records_mart": _over_star(json_records_mart),
    "monthly_sales_in_order": _over_star(monthly_sales_in_order),
    **{f"pushed_{mart}": _pushed(mart) for mart in MARTS},
    "next_purchase_label": _over_star(next_purchase),
    "latest_customer_month": _over_star(latest_customer_month),
    "latest_customer_month_in_year": _over_star(latest_customer_month_in_year),
    "latest_customer_month_in_month": _over_star(latest_customer_month_in_month),
    "category_vocabulary": _over_star(category_vocabulary_query),
    "indicators_customer": _over_star(indicators_customer),
    "indicators_territory": _over_star(indicators_territory),
    "scale_monthly": _over_star(scale_monthly),
    "scale_customer": _over_star(scale_customer),
    "align_columns": _over_star(align_columns_query),
    "holdout_split": _over_star(holdout_split_query),
    "forecast_sales": _job(
        tc.monthly_sales,
        tc.train_sales,
        lambda star, path, mart: tc.forecast_sales(star, path, YEAR, mart=mart),
    ),
    "forecast_sales_one_month": _job(
        tc.monthly_sales,
        tc.train_sales,
        lambda star, path, mart: tc.forecast_sales(star, path, YEAR, month=7, mart=mart),
    ),
    "forecast_demand": _job(
        tc.monthly_demand,
        tc.train_demand,
        lambda star, path, mart: tc.forecast_demand(star, path, YEAR, mart=mart),
    ),
    # From the star: the mart is aggregated anew.
    "forecast_demand_default_year": _job(
        tc.monthly_demand, tc.train_demand, lambda star, path, mart: tc.forecast_demand(star, path)
    ),
    "forecast_sales_forest": _job(
        tc.monthly_sales,
        tc.train_sales_forest,
        lambda star, path, mart: tc.forecast_sales_forest(star, path, YEAR, mart=mart),
    ),
    "forecast_regional": _job(
        tc.regional_monthly,
        tc.train_regional,
        lambda star, path, mart: tc.forecast_regional(star, path, YEAR, mart=mart),
    ),
    "forecast_regional_one_territory": _job(
        tc.regional_monthly,
        tc.train_regional,
        lambda star, path, mart: tc.forecast_regional(
            star, path, YEAR, territory="EUROPE", mart=mart
        ),
    ),
    "score_customers": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: tc.score_customers(star, path, mart=mart),
    ),
    # From the star: the year filter reaches the scans.
    "score_customers_in_year": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: tc.score_customers(star, path, year=LAST_FULL_YEAR),
    ),
    "top_customers": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: tc.score_customers(star, path, top_n=10, mart=mart),
    ),
    "forecast_sales_forest_exact": _job(
        tc.monthly_sales,
        tc.train_sales_forest,
        lambda star, path, mart: tc.forecast_sales_forest(star, path, YEAR, mart=mart),
        EXACT,
    ),
    "forecast_regional_exact": _job(
        tc.regional_monthly,
        tc.train_regional,
        lambda star, path, mart: tc.forecast_regional(star, path, YEAR, mart=mart),
        EXACT,
    ),
    "forecast_regional_one_territory_exact": _job(
        tc.regional_monthly,
        tc.train_regional,
        lambda star, path, mart: tc.forecast_regional(
            star, path, YEAR, territory="EUROPE", mart=mart
        ),
        EXACT,
    ),
    "score_customers_exact": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: _scores(tc.score_customers(star, path, mart=mart)),
        EXACT,
    ),
    "score_customers_in_year_exact": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: _scores(tc.score_customers(star, path, year=LAST_FULL_YEAR)),
        EXACT,
    ),
    "top_customers_exact": _job(
        tc.customer_monthly,
        tc.train_customer,
        lambda star, path, mart: _in_order(
            _scores(tc.score_customers(star, path, top_n=10, mart=mart))
        ),
        EXACT,
    ),
}

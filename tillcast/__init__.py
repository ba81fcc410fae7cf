"""Retail sales forecasting and customer purchase scoring on Spark."""

from tillcast.errors import ModelNotTrained, UntrainableData
from tillcast.operators.calendar import with_month_index
from tillcast.operators.marts import (
    customer_monthly,
    monthly_demand,
    monthly_sales,
    regional_monthly,
)
from tillcast.plans.features import customer_features, regional_features
from tillcast.plans.jobs import (
    forecast_demand,
    forecast_regional,
    forecast_sales,
    forecast_sales_forest,
    score_customers,
    train_customer,
    train_demand,
    train_regional,
    train_sales,
    train_sales_forest,
)
from tillcast.plans.models import ForestSettings
from tillcast.sources import (
    StarSchema,
    counted_split,
    jdbc_mart,
    jdbc_star,
    json_records,
    mart_sql,
    parquet_star,
    retail_star,
    write_mart,
    write_results,
)

__all__ = [
    "ForestSettings",
    "ModelNotTrained",
    "StarSchema",
    "UntrainableData",
    "counted_split",
    "customer_features",
    "customer_monthly",
    "forecast_demand",
    "forecast_regional",
    "forecast_sales",
    "forecast_sales_forest",
    "jdbc_mart",
    "jdbc_star",
    "json_records",
    "mart_sql",
    "monthly_demand",
    "monthly_sales",
    "parquet_star",
    "regional_features",
    "regional_monthly",
    "retail_star",
    "score_customers",
    "train_customer",
    "train_demand",
    "train_regional",
    "train_sales",
    "train_sales_forest",
    "with_month_index",
    "write_mart",
    "write_results",
]

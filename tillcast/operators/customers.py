"""Per-customer windows: the label and the latest month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import positive_flag
from tillcast.operators.marts import CUSTOMER_TRAITS


def next_purchase_label(mart: DataFrame) -> DataFrame:
    """Add ``NextPurchase``: 1 if the customer has a later month in the mart, else 0.

    "Next" is the next observed month, however far away. The last month of a customer
    has no next one, gets 0 and stays.
    """
    # The traits only break ties, when a customer is listed more than once.
    later = Window.partitionBy("CustomerKey").orderBy("Year", "Month", *CUSTOMER_TRAITS)
    following = F.lead("PurchaseCount", 1).over(later)
    return mart.withColumn("NextPurchase", positive_flag(following)).dropna(
        subset=["NextPurchase"]
    )


def latest_month(mart: DataFrame) -> DataFrame:
    """The last row of each customer, of a mart with or without the traits. Filter by year or
    month before, not after.

    Spark keeps only each task's last row per customer before the shuffle
    (WindowGroupLimit).
    """
    newest = Window.partitionBy("CustomerKey").orderBy(
        *[F.desc(c) for c in ("Year", "Month", *CUSTOMER_TRAITS) if c in mart.columns]
    )
    return (
        mart.withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") == 1)
        .drop("recency")
    )

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from acceptance.queries import QUERIES
from tillcast.session import configure

HEADLINES = [
    "monthly_sales",
    "monthly_demand",
    "regional_monthly",
    "customer_monthly",
    "distinct_orders_customers",
    "next_purchase_label",
    "latest_customer_month",
    "latest_customer_month_in_year",
    "month_profile_sales",
    "territory_month_spine",
    "indicators_customer",
    "scale_customer",
    "category_vocabulary",
    # A job's first query includes the training, later ones score the stored model.
    "forecast_sales",
    "forecast_demand",
    "forecast_sales_forest",
    "forecast_regional",
    "score_customers",
    "score_customers_in_year",
    "top_customers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"), cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths before timing.
    QUERIES["raw_group_null_default"](spark, folder).collect()

    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

from tillcast.sources.retail import retail_star
from tillcast.sources.sinks import json_records, write_mart, write_results
from tillcast.sources.star import StarSchema, jdbc_star, parquet_star
from tillcast.sources.warehouse import counted_split, jdbc_mart, mart_sql

__all__ = [
    "StarSchema",
    "counted_split",
    "jdbc_mart",
    "jdbc_star",
    "json_records",
    "mart_sql",
    "parquet_star",
    "retail_star",
    "write_mart",
    "write_results",
]

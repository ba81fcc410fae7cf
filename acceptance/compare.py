"""Run the registered queries against their SQL: ``python -m acceptance.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from acceptance.oracle import ORACLES
from acceptance.queries import QUERIES
from tillcast.session import configure


def normal(value: object) -> object:
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else value


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def differences(result: DataFrame, folder: str, name: str) -> str | None:
    """None if both engines agree on columns, row count and every value."""
    got = normal_rows(result.columns, [tuple(r) for r in result.collect()])
    if name not in ORACLES:
        return None if got else "no rows"
    columns, rows = oracle_rows(folder, ORACLES[name])
    expected = normal_rows(columns, rows)
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        configure(SparkSession.builder.master("local[8]"), 8)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.perf_counter()
        problem = differences(QUERIES[name](spark, folder), folder, name)
        failed += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{problem or 'ok':<8} {time.perf_counter() - start:6.2f}s {kind:<4} {name}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

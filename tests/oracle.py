"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def normalised(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, folder: str, query, result=None) -> tuple[bool, str]:
    result = query.build(spark, folder) if result is None else result
    actual = normalised([tuple(row) for row in result.collect()], result.columns)
    if query.sql is None:
        return True, f"{len(actual)} rows, no SQL"
    relation = connection.execute(query.sql)
    columns = [item[0] for item in relation.description]
    expected = normalised(relation.fetchall(), columns)
    if sorted(columns) != sorted(result.columns):
        return False, f"columns {sorted(result.columns)} != {sorted(columns)}"
    if len(actual) != len(expected):
        return False, f"{len(actual)} rows != {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if mine != theirs or any(type(a) is not type(b) for a, b in zip(mine, theirs)):
            return False, f"{sorted(columns)}\n  spark {str(mine)[:1500]}\n  sql   {str(theirs)[:1500]}"
    return True, f"{len(actual)} rows"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from quotelock.plans import catalog
    from quotelock.plans.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failures = 0
    for name, query in catalog.load().items():
        if names and not any(name == n or n in query.build.__module__ for n in names):
            continue
        started = time.time()
        try:
            passed, note = compare(spark, connection, folder, query)
        except Exception as error:  # noqa: BLE001 - report and go on
            passed, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failures += not passed
        print(f"{'ok  ' if passed else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    raise SystemExit(main())

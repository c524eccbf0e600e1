"""Side-by-side run of registered queries and their DuckDB oracles."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from wrenchbook.plans.bindings import BASE_TABLES
from wrenchbook.plans.registry import all_queries
from wrenchbook.session import local_session


def oracle_connection(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return "" if value is None else f"{type(value).__name__}:{value}"


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, directory):
    """None when equal, else a short description of the difference."""
    df = query.run(spark, directory)
    spark_columns = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    sql = query.sql()
    if sql is None:
        return None, len(spark_rows)
    cursor = connection.execute(sql)
    duck_columns = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} != {sorted(duck_columns)}", len(spark_rows)
    left, right = normal_rows(spark_columns, spark_rows), normal_rows(duck_columns, duck_rows)
    if left == right:
        return None, len(left)
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"rows {len(left)} != {len(right)}; columns {sorted(spark_columns)}; spark {only_left}; oracle {only_right}", len(left)


def main(argv):
    directory = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(directory)
    failed = 0
    for name, query in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            problem, rows = compare(spark, connection, query, directory)
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0
        status = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        note = "" if query.oracle else " (no oracle)"
        print(f"{status} {name:32s} rows={rows:7d} {time.time() - started:6.2f}s{note} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

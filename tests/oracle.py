"""Compare a registered query with its SQL form in DuckDB."""

from __future__ import annotations

import os

import duckdb
import numpy as np

from featloom.workload.views import BASE

DATA = os.environ.get("FEATLOOM_TESTDATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value)))
    return (3, str(value))


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = sorted(tuple(_plain(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], cleaned


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return canonical(columns, result.fetchall())

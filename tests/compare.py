"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time() else value
    return value


def spark_rows(frame):
    order = sorted(frame.columns)
    rows = [tuple(_plain(row[name]) for name in order) for row in frame.collect()]
    return order, sorted(rows, key=repr)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    order = sorted(names)
    places = [names.index(name) for name in order]
    rows = [tuple(_plain(row[i]) for i in places) for row in cursor.fetchall()]
    return order, sorted(rows, key=repr)

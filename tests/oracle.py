"""Compare registered queries with their SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        connection.execute(f"create view {table} as select * from read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value, ".10g")
    return value


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def compare(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = _rows(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{str(mine)[:600]}\n   expected {str(theirs)[:600]}"
    return None

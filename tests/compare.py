"""Runs a named query on Spark and its SQL twin on DuckDB and compares the rows, in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = normal(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    found = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)} expected; only found {[r for r in found if r not in expected][:2]}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(wrong)} of {len(found)} rows differ, first {wrong[:2]}" if wrong else None

"""Comparing queries with their SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[name]) for name in names) for row in df.collect())


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    names = sorted(columns)
    order = [columns.index(name) for name in names]
    return names, Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Return '' when both give the same columns and rows, else what differs."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(connection, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if ours != theirs:
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
        )
    return ""

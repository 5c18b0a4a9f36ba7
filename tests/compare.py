"""Compare registered queries with their SQL checks, as multisets of rows by column name."""

from __future__ import annotations

import collections
import datetime
import glob
import os

import duckdb

SF_ENV = "PKGWARDEN_SF_DIR"
DEFAULT_SF = "/root/testdata/sf0.001"


def sf_dir() -> str:
    return os.environ.get(SF_ENV, DEFAULT_SF)


def oracle(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def as_multiset(columns, rows) -> tuple[list[str], collections.Counter]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    counted = collections.Counter(tuple(_plain(row[i]) for i in at) for row in rows)
    return [columns[i] for i in at], counted


def spark_result(df):
    return as_multiset(df.columns, df.collect())


def oracle_result(connection, sql: str):
    relation = connection.sql(sql)
    return as_multiset(relation.columns, relation.fetchall())

"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if isinstance(value, dict):
        return str({k: _plain(v) for k, v in value.items()})
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    return [columns[i] for i in order], rows


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when the rows agree (or there is no SQL), else what differs."""
    names, got = rows_of_spark(QUERIES[name](spark, sf_dir))
    if not got:
        return "no rows"
    if name not in ORACLES:
        return None
    want_names, want = rows_of_sql(con, ORACLES[name])
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}"
    return None

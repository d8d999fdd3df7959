"""Runs every query against its SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.session import local_session

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, bool) or not isinstance(value, int):
        return value
    return float(f"{value:.12g}")


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same bag of rows under the same column names."""
    mine = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, b = _bag(df.columns, mine), _bag(names, theirs)
    if a == b:
        return None
    left, right = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"{len(mine)} / {len(theirs)} rows, {sum((a - b).values())} differ: {left} {right}"


def run(spark: SparkSession, sf_dir: str, names: list[str]) -> list[str]:
    con, failed = connect(sf_dir), []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                found = differences(df, con, ORACLE[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - a broken query is one more difference
            found = f"{type(error).__name__}: {str(error)[:600]}"
        verdict = "rows only" if name not in ORACLE else "ok"
        print(f"{time.time() - start:6.2f}s {name}: {found or verdict}", flush=True)
        if found:
            failed.append(name)
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    bad = run(local_session(), folder, sys.argv[2:])
    print(f"{len(bad)} of {len(sys.argv[2:] or QUERIES)} differ: {bad}")
    sys.exit(bool(bad))

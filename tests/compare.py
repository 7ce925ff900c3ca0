"""Runs queries beside their DuckDB SQL: python tests/compare.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same rows, or what differs."""
    got, rel = df.collect(), con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(df.columns, got), rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    return next((f"row {x}\n and {y}" for x, y in zip(a, b, strict=True) if x != y), None)


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf" and a != sf]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = duck(sf), e.queries(), e.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            why = difference(queries[name](spark, sf), con, oracles[name]) if name in oracles else f"no SQL; {queries[name](spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[-260:] if 'Python worker' in str(x) else str(x)[:260]}"
        bad += name in oracles and why is not None
        print(f"{name}: {'same' if why is None else why} ({time.time() - began:.1f} s)", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

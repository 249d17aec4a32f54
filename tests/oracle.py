"""Runs registered queries on Spark and their SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def rows(names, data) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in data)


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str | None:
    """None when equal, else what differs."""
    con = con or connect(sf_dir)
    frame = query(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra, lost = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows != {len(want)}; only ours {extra}; only theirs {lost}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference: {g} != {w}"
    return None if got else "no rows"

"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def database(sf_dir: str = SMALL):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(columns, found) -> list[tuple]:
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


def same(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())

"""Holds a query against its SQL: same columns, same rows whatever their order, exact values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return float(value)
    return str(value)


def same_rows(df, con, sql: str) -> None:
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in at) for row in want.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    assert len(got) == len(expected)
    assert got == expected

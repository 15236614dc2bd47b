"""Rows of a query against those of its SQL in DuckDB."""

import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def plain(value):
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(df, con, sql: str) -> None:
    got = [tuple(plain(v) for v in row) for row in df.collect()]
    found = con.sql(sql)
    columns, types = found.columns, dict(zip(found.columns, map(str, found.types)))
    assert sorted(columns) == sorted(df.columns)
    for name, kind in df.dtypes:
        assert KINDS.get(kind, types[name]) == types[name], (name, kind, types[name])
    at = [columns.index(c) for c in df.columns]
    want = [tuple(plain(row[i]) for i in at) for row in found.fetchall()]
    assert sorted(got, key=key) == sorted(want, key=key)

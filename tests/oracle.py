"""Comparison of a query with its SQL."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows_of(values) -> list[str]:
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row)) for row in values)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert columns == sorted(found.columns)
    ours = rows_of(tuple(r[c] for c in columns) for r in df.collect())
    theirs = rows_of(found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs

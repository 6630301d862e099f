"""Compares queries with their SQL in DuckDB on the same tables, over all rows and columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(DATA, sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def norm(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def compare(spark, con, query, sql: str, sf: str) -> None:
    df = query(spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())

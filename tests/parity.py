"""Results of a query in Spark and in DuckDB as comparable sets of rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, query, sql: str, folder: str) -> tuple[Counter, Counter]:
    """Rows that only Spark has, and that only DuckDB has."""
    df = query(spark, folder)
    ours = rows(df.columns, df.collect())
    got = connection(folder).execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    theirs = rows(names, got.fetchall())
    return ours - theirs, theirs - ours

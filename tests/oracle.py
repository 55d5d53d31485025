"""Compare each query with its SQL in DuckDB: column names, row count and values, whatever the row order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", float(v)) for v in row)


def _family(v):
    return "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else type(v).__name__


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    ours = sorted((tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    theirs = sorted((tuple(_plain(row[i]) for i in order) for row in cur.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{dict(zip(names, a))} against {dict(zip(names, b))}"
        if [_family(x) for x in a] != [_family(x) for x in b]:
            return f"types {dict(zip(names, map(_family, a)))} against {dict(zip(names, map(_family, b)))}"
    return None

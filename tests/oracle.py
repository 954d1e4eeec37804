"""Holds a query's rows against its SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
import os
from glob import glob

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, dict):
        return str(sorted((k, cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{p}'")
    con.execute("set timezone='UTC'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if equal; else what differs."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == exp:
        return ""
    only = lambda a, b: [x for x in a if x not in set(b)][:3]
    return f"{len(got)} rows against {len(exp)}; only here {only(got, exp)}; only there {only(exp, got)}"

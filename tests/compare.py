"""Compare a query with its SQL in DuckDB, as order-insensitive rows of name-sorted columns."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    want = con.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_types = {d[0]: str(d[1]) for d in want.description}
    expected, names = rows_of(want_columns, want.fetchall())
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} != {names}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first: {bad[0]} types {want_types} {df.dtypes}"
    return None if expected else "empty result"

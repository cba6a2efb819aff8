"""Runs a query and its DuckDB SQL on one directory and compares them, order aside."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{directory}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def compare(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(_plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in result.fetchall()), key=key)
    got = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    if got != want:
        odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"[:600]
    return ""

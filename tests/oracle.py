"""Runs a query and its SQL side by side and compares all rows."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, (float, np.floating)):
        return None if v != v else float(v) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data) -> list[tuple]:
    order = [int(i) for i in np.argsort(names)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None, or what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = rows(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    return next((f"{a} against {b}" for a, b in zip(got, want, strict=True) if a != b), None)

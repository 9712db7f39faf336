"""Compare a registered query with its SQL on DuckDB, value by value."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def typed(value):
    """A float and an int of equal value are told apart."""
    return (type(value).__name__, value)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    pos = [theirs.index(n) for n in names]
    want = Counter(tuple(typed(plain(row[i])) for i in pos) for row in result.fetchall())
    got = Counter(tuple(typed(plain(row[n])) for n in names) for row in df.collect())
    if want == got:
        return None
    extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"{sum(got.values())} rows, expected {sum(want.values())}; only ours {extra}; only theirs {lacking}"

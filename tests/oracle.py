"""Run a registered query in Spark and its SQL in DuckDB, and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
DATA = os.environ.get("COTEJO_DATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize() if v else decimal.Decimal(0)))
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items(), key=lambda kv: str(kv[0])))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(df, sql: str, con) -> str | None:
    """None when equal, else a short description of the first difference."""
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = _sorted_rows(want_cols, cur.fetchall())
    got = _sorted_rows(df.columns, df.collect())
    if sorted(want_cols) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(want_cols)}"
    if len(want) != len(got):
        extra = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        return f"row counts differ: spark {len(got)} sql {len(want)}; {extra}"
    if want != got:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ; spark {bad[0][0]} sql {bad[0][1]}; columns {sorted(df.columns)}"
    if not got:
        return "EMPTY"
    return None

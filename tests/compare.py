"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in data)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    kinds = {}
    for f in df.schema.fields:
        kinds[f.name] = f.dataType.simpleString()
    for d in cur.description:
        k, t = kinds[d[0]], str(d[1]).lower()
        same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
                "boolean": "boolean"}.get(k)
        if same is None or same != t:
            return f"type of {d[0]}: {k} / {t}"
    a, b = rows(df.columns, got), rows(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        return (f"{len(bad)} of {len(a)} differ\n  cols {sorted(df.columns)}\n  spark only {sorted(sa - sb)[:3]}"
                f"\n  sql only {sorted(sb - sa)[:3]}")
    return f"ok {len(a)}"

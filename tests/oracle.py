"""Runs a registered query and its SQL on the same tables and compares columns and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_value(y) for y in x) + "]"
    if isinstance(x, bool) or x is None or not isinstance(x, (int, str)):
        return str(x)
    return str(x)


def compared(spark, run, sql: str, sf_dir: str) -> tuple[list, list, list[str], list[str]]:
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    own = [d[0] for d in cur.description]
    order = sorted(range(len(own)), key=lambda i: own[i])
    want = sorted(tuple(_value(r[i]) for i in order) for r in cur.fetchall())
    return got, want, names, sorted(own)

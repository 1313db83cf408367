"""Runs queries of the catalogue and their SQL over one folder of tables and compares rows."""

from __future__ import annotations

import glob
import os


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "~"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(spark, con, folder: str, query, sql: str) -> tuple[int, str]:
    df = query(spark, folder)
    rows = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(plain(r[df.columns.index(c)]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    if mine == theirs:
        return len(mine), ""
    return len(mine), f"{len(mine)} and {len(theirs)} rows; only here {[m for m in mine if m not in set(theirs)][:2]}; only there {[t for t in theirs if t not in set(mine)][:2]}"

"""Comparison of a query with its oracle: rows as sets, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return f"{x + 0.0:.6g}" if math.isfinite(x) else str(x)
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.6g}" if abs(x) < 1e6 else x
    return str(x)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows; else what differs."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    mine = Counter(tuple(_value(r[n]) for n in names) for r in got.collect())
    db = duckdb.connect()
    db.execute("SET threads=4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = db.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(_value(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    return f"{names}: {sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"

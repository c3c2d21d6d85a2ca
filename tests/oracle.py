"""Runs a query and its SQL and compares them as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def compare(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = [tuple(_plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in names]).collect()]
    cur = connect(sf_dir).execute(sql)
    wanted_names = [d[0] for d in cur.description]
    assert sorted(wanted_names) == names, (sorted(wanted_names), names)
    order = [wanted_names.index(c) for c in names]
    wanted = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    assert len(rows) == len(wanted), (len(rows), len(wanted))
    left, right = Counter(rows), Counter(wanted)
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])

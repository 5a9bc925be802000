"""Run registered queries next to their oracles.

    python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from shelfcheck.plans.bridge import SOURCES  # noqa: E402
from shelfcheck.session import local_session  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for t in SOURCES + ["embeddings", "benchmark", "labels", "conversations"]:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """None when Spark and the oracle agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    want = rows_of(columns, cur.fetchall())
    if not want:
        return "oracle has no rows"
    if got == want:
        return None
    a, b = {tuple(map(str, r)) for r in got}, {tuple(map(str, r)) for r in want}
    return f"{len(got)} / {len(want)} rows; columns {sorted(columns)}; only Spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    folder = f"/root/testdata/{sf}"
    session = local_session()
    connection = oracle_connection(folder)
    bad = 0
    for key in contract.queries():
        if not key.startswith(prefixes):
            continue
        started = time.time()
        try:
            problem = compare(session, connection, folder, key)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        note = "" if key in contract.oracle_sql() else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {key}{note} {time.time() - started:.1f}s {problem or ''}"[:1500], flush=True)
    print("failed:", bad)

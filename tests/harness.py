"""Runs registered queries against their SQL twins. Usage: python tests/harness.py [names...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from lexiloom.plans import ORACLES, QUERIES
from lexiloom.plans.registry import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def norm(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, int):
        return (2, str(value))
    if isinstance(value, decimal.Decimal):
        return (9, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (3, "nan")
        return (3, repr(value + 0.0))
    if isinstance(value, datetime.datetime):
        return (4, value.isoformat())
    if isinstance(value, (list, tuple)):
        return (5, str([norm(v) for v in value]))
    return (6, str(value))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows])


def compare(name: str, spark, sf_dir: str, con=None) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in ORACLES:
        return True, f"rows-only n={len(rows)} {took:.1f}s"
    con = con or duck(sf_dir)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    c1, r1 = canonical(df.columns, rows)
    c2, r2 = canonical(cols, want)
    if c1 != c2:
        return False, f"columns {c1} != {c2}"
    if r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
        return False, f"n={len(r1)} vs {len(r2)} first diff {str(diff)[:700]}"
    return True, f"n={len(r1)} {took:.1f}s"


if __name__ == "__main__":
    import traceback

    from lexiloom.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = duck(sf)
    names = sys.argv[1:] or list(QUERIES)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(n, spark, sf, con)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        bad += not ok
        print(("ok  " if ok else "FAIL"), n, msg, flush=True)
    print("failed", bad, "of", len(names))

"""Runs queries beside their SQL and compares the rows: python -m tests.compare SF_DIR [NAME...]"""

import glob
import os
import sys
import time

import duckdb


def norm(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, sf_dir, name, query, sql):
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != cols:
        return f"columns {cols} against {sorted(have)}"
    at = [have.index(c) for c in cols]
    want = sorted((tuple(norm(r[k]) for k in at) for r in cur.fetchall()), key=str)
    if rows != want:
        a, b = set(rows), set(want)
        return f"{len(rows)} rows against {len(want)}; only here {list(a - b)[:3]}, only there {list(b - a)[:3]}"
    return None if rows else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from netquarry.core import local_session

    spark, queries, sql = local_session(cores=4), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            why = compare(spark, sys.argv[1], name, queries[name], sql[name])
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(why)
        print(f"{name}: {'equal' if not why else why} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bad)

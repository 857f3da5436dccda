"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Comparison: row count, column names, and the multiset of rows (values
rendered as text, floats exactly by ``repr``) after sorting the columns by
name.  Usable from pytest and as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)  # exact: both engines must produce the same double
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], out


def compare(spark, con, name: str, sf_dir: str):
    import __spark_entry__ as E

    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    df = q(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols = df.columns
    if sql is None:
        return dict(name=name, ok=None, rows=len(rows), spark_s=t1 - t0)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    c1, r1 = canon(cols, rows)
    c2, r2 = canon(dcols, drows)
    ok = c1 == c2 and r1 == r2
    diff = None
    if not ok:
        s1, s2 = set(r1), set(r2)
        diff = dict(cols=(c1, c2), n=(len(r1), len(r2)), only_spark=sorted(s1 - s2)[:3],
                    only_duck=sorted(s2 - s1)[:3])
    return dict(name=name, ok=ok, rows=len(rows), spark_s=t1 - t0, diff=diff)


if __name__ == "__main__":
    from vocaframe.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E

    names = sys.argv[2:] or list(E.queries())
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf)
        except Exception as e:  # report and go on
            r = dict(name=n, ok=False, error=repr(e)[:2000])
        if not r.get("ok"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)

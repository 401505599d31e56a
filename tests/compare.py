"""Run registered queries next to their SQL and compare whole results (also usable as a script)."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("BENCHWEAVE_DATA", "/root/testdata")


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), sorted(columns)


def compare(spark, con, sf_dir, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, sf_dir)
    got, got_cols = rows_of(df.columns, df.collect())
    sql = E.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got), None
    cur = con.execute(sql)
    want, want_cols = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return "columns differ", got_cols, want_cols
    if got != want:
        have, need = set(got), set(want)
        only_got = [r for r in got if r not in need][:3]
        only_want = [r for r in want if r not in have][:3]
        return "rows differ", (len(got), only_got), (len(want), only_want)
    return "ok", len(got), None


if __name__ == "__main__":
    import __spark_entry__ as E

    from benchweave.session import get_session

    sf = f"{DATA}/sf{os.environ.get('SF', '0.01')}"
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = [n for n in E.queries() if len(sys.argv) == 1 or any(n.startswith(a) for a in sys.argv[1:])]
    bad = []
    for name in names:
        start = time.time()
        try:
            state, a, b = compare(spark, con, sf, name)
        except Exception as exc:  # show every failure of the sweep
            state, a, b = "error", str(exc)[:900], None
        if state not in ("ok", "rows-only"):
            bad.append(name)
        print(f"{state:15s} {name:28s} {time.time() - start:6.2f}s {a} {b or ''}", flush=True)
    print(f"{len(names)} queries, {len(bad)} bad: {bad}")

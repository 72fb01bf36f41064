"""Compare catalogue queries with their SQL in DuckDB. Usage: check_catalog.py [folder] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        line = []
        for i in order:
            v = row[i]
            if isinstance(v, float) and math.isnan(v):
                v = "nan"
            elif isinstance(v, float) and v == 0 and math.copysign(1, v) < 0:
                v = "-0.0"
            line.append("" if v is None else str(v))
        out.append(tuple(line))
    return sorted(out)


def compare(spark, con, name, run, sql, folder):
    start = time.time()
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return got and "rows only", f"{len(got)} rows", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = cells(got, df.columns), cells(want, names)
    if a == b:
        return bool(a), f"{len(a)} rows", took
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{len(a)} vs {len(b)} rows; {sorted(names)}; {diff}", took


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def main():
    import __spark_entry__ as entry
    from tidemark.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = session("check"), connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if chosen and name not in chosen:
            continue
        try:
            ok, note, took = compare(spark, con, name, run, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {took:6.2f}s {name}: {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

"""Run registered queries beside their SQL twins and report differences.

usage: python tools/compare.py <folder> [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if hasattr(value, "toArray"):
        return str(value.toArray().tolist())
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder):
    df = query.run(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return f"rows only ({len(ours)})", len(ours) > 0
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", False
    if ours != theirs:
        missing = [r for r in theirs if r not in set(ours)][:3]
        extra = [r for r in ours if r not in set(theirs)][:3]
        return f"{len(ours)} rows vs {len(theirs)}; only sql {missing}; only spark {extra}", False
    return f"equal ({len(ours)})", True


def main():
    from tablewright.catalog import all_queries
    from tablewright.session import local_session

    folder, wanted = sys.argv[1], set(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for q in all_queries():
        if wanted and q.name not in wanted and not any(w.endswith("*") and q.name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, q, folder)
        except Exception as e:
            text, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q.name} {time.time() - start:.1f}s {text}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

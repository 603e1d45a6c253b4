"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    # whole numbers with nulls are floats in the one frame and masked integers in the other
    frame = frame.astype({c: "float64" for c, kind in frame.dtypes.items() if str(kind).startswith("Int")})

    def show(v):
        if v is None or pd.isna(v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return repr(float(v) + 0.0)
        if isinstance(v, (list, dict)) or hasattr(v, "dtype") and getattr(v, "ndim", 0):
            return repr(v)
        return str(v)

    return list(frame.columns), sorted(tuple(show(v) for v in row) for row in frame.itertuples(index=False))


def kinds(frame):
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def check(spark, con, folder, name, build, sql):
    start = time.time()
    got = build(spark, folder).toPandas()
    spark_s = time.time() - start
    if sql is None:
        return f"rows {len(got)}", spark_s, 0.0, True
    start = time.time()
    want = con.execute(sql).df()
    duck_s = time.time() - start
    gc, gr = canonical(got)
    wc, wr = canonical(want)
    if gc != wc:
        return f"COLUMNS {gc} / {wc}", spark_s, duck_s, False
    if len(gr) != len(wr):
        return f"ROWS {len(gr)} / {len(wr)}", spark_s, duck_s, False
    if gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b]
        return f"VALUES {len(bad)} of {len(gr)}: {bad[:2]}", spark_s, duck_s, False
    note = "" if kinds(got) == kinds(want) else f" kinds {[(k, v, kinds(want)[k]) for k, v in kinds(got).items() if v != kinds(want)[k]]}"
    return f"ok {len(gr)}{note}" + (" EMPTY" if not gr else ""), spark_s, duck_s, bool(gr)


def main(folder, patterns):
    import fnmatch

    import __spark_entry__ as entry
    from strandframe.session import build_session

    spark = build_session()
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if patterns and not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        try:
            note, a, b, ok = check(spark, con, folder, name, build, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            note, a, b, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0, 0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:34s} {a:6.2f}s {b:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

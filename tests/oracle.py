"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/oracle.py [--sf DIR] [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from plumbline.runtime import local_session  # noqa: E402
from plumbline.showcase import registry, views  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)) and not hasattr(v, "_fields"):
        return [_plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([_plain(r[i]) for i in order]) for r in rows))


def compare(spark, con, name, sf_dir, fn, sql):
    """None when equal, else a message."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, t1 - t0, 0.0, len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    message = None
    if sorted(cols) != sorted(df.columns):
        message = f"columns {sorted(df.columns)} != {sorted(cols)}"
    else:
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b:
            only_a = [x for x in a if x not in set(b)][:3]
            only_b = [x for x in b if x not in set(a)][:3]
            message = f"rows {len(a)} vs {len(b)}\n   spark: {only_a}\n   sql:   {only_b}"
    odd = {c: t for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t}
    if odd and not message:
        message = f"SQL types to cast: {odd}"
    if not message:
        spark_t = dict(df.dtypes)
        same = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int",
                "BOOLEAN": "boolean"}
        diff = {c: (spark_t[c], t) for c, t in types.items() if t in same and same[t] != spark_t[c]}
        if diff:
            message = f"types differ: {diff}"
    return message, t1 - t0, t2 - t1, len(got)


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = registry.queries(), registry.oracle_sql()
    chosen = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in chosen:
        try:
            msg, a, b, n = compare(spark, con, name, sf, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            msg, a, b, n = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
        bad += bool(msg)
        kind = "rows" if name not in sqls else "sql "
        print(f"{'FAIL' if msg else 'ok  '} {kind} {name:36s} {n:7d} rows  spark {a:6.2f}s  sql {b:5.2f}s",
              flush=True)
        if msg:
            print("   ", msg, flush=True)
    print(f"{len(chosen)} queries, {bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

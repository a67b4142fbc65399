"""Compare registered queries with their SQL checks in DuckDB.

    python tests/check_queries.py [sf] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if v is not None else "null"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


FAMILY = {
    "bigint": "int", "int": "int", "smallint": "int", "integer": "int", "hugeint": "HUGEINT",
    "double": "double", "float": "float", "string": "str", "varchar": "str", "boolean": "bool",
}


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, rows, seconds)"""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, "no SQL", len(got), took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(set(df.columns) ^ set(want_cols))}", len(got), took
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    for f in df.schema.fields:
        a, b = f.dataType.simpleString(), kinds[f.name]
        if FAMILY.get(a, a) != FAMILY.get(b, b) or a.replace("bigint", "bigint") != {"integer": "int", "varchar": "string"}.get(b, b):
            return False, f"type of {f.name}: {a} vs {b}", len(got), took
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"rows {len(a)} vs {len(b)}; cols {sorted(df.columns)}; first differences {diff}", len(got), took
    return True, "match", len(got), took


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from latticeworks.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, msg, n, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg, n, took = False, f"{type(e).__name__}: {str(e)[:900]}", -1, 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:45s} rows={n:6d} {took:6.2f}s {msg if not ok or sqls.get(name) is None else ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

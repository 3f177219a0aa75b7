"""Run catalogue queries against DuckDB: python tests/check_oracle.py [sf] [name-prefix ...]"""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    import datetime
    import decimal
    import math
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v) if not isinstance(v, str) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name, run, sql):
    t = time.time()
    df = run(spark, folder)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", took
    cur = con.execute(sql)
    want_cols, want = rows([c[0] for c in cur.description], cur.fetchall())
    types = {c[0]: str(c[1]) for c in cur.description}
    loose = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    bad = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if n in types and loose.get(types[n], t) != t]
    if got_cols != want_cols:
        return f"COLUMNS differ {set(got_cols) ^ set(want_cols)}", took
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"DIFF spark={len(got)} duck={len(want)}\n   S {sorted(a - b)[:2]}\n   D {sorted(b - a)[:2]} cols={got_cols}", took
    return ("ok" if not bad else f"ok TYPES {bad}") + f" {len(got)}", took


def main():
    import duckdb
    from newsgauge.session import build_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    sqls = E.oracle_sql()
    good = n = 0
    for name, run in E.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        n += 1
        try:
            res, took = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            res, took = "ERROR " + str(e).replace("\n", " ")[:700], 0
        good += res.startswith(("ok", "rows-only"))
        print(f"{name:28} {took:5.1f}s {res}", flush=True)
    print(f"{good}/{n} good")


if __name__ == "__main__":
    main()

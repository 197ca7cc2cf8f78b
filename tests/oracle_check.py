"""Run registered queries next to their SQL on DuckDB: ``python -m tests.oracle_check [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, detail, seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL", took
    relation = con.sql(sql)
    want_names = relation.columns
    want = relation.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} vs {sorted(want_names)}", took
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows {len(a)} vs {len(b)}; only spark {list(sa - sb)[:2]}; only sql {list(sb - sa)[:2]}", took
    if not got:
        return False, "no rows", took
    return True, f"{len(got)} rows", took


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(prefixes):
    from titrate.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, detail, took = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, detail, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:44s} {took:6.2f}s {detail}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])

"""Side-by-side run of the registered queries and their DuckDB SQL.

python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return repr(x + 0.0)
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    return str(x)


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, con, query, sql: str | None) -> tuple[str, int]:
    df = query(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", len(got)
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"VALUES differ in {len(bad)}: {bad[:2]}" if bad else "match"), len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from civiflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/sf{sf}"
    con = connect(sf_dir)
    oracle = entry_module.oracle_sql()
    failed = []
    for name, query in entry_module.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            result, n = compare(spark, sf_dir, con, query, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            result, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1
        if result not in ("match", "rows only"):
            failed.append(name)
        print(f"{name:32s} {time.time() - started:6.1f}s rows={n} {result}", flush=True)
    print("FAILED:", failed)

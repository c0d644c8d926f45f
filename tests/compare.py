"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

Usage: python tests/compare.py FOLDER [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(dtype: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}.get(dtype, dtype)


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


def compare(spark, con, folder: str, name: str) -> str:
    """Empty when equal, else what differs."""
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=_sortable)
    if name not in entry.oracle_sql():
        return ""
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    types = {d[0]: str(d[1]) for d in want.description}
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    wrong = {c: (_kind(t), types[c]) for c, t in got.dtypes if _kind(t) != types[c]}
    if wrong:
        return f"types {wrong}"
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=_sortable)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    different = [(a, e) for a, e in zip(rows, expected) if a != e]
    return f"{len(different)} rows differ, first {different[0]}" if different else ""


if __name__ == "__main__":
    from accountscope.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    for name in wanted or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        checked = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {checked} {time.time() - start:6.1f}s {name} {problem}"[:900], flush=True)

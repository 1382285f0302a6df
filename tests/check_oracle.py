"""Run catalogue queries next to their SQL and report differences.

Usage: python tests/check_oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(_cell(r[i])) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, build, sql):
    start = time.time()
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(rows), None
    start = time.time()
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(columns) != sorted(df.columns):
        return took, len(rows), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = canonical(rows, df.columns), canonical(want, columns)
    if a == b:
        return took, len(rows), ""
    in_a, in_b = set(a), set(b)
    extra = [x for x in a if x not in in_b][:3]
    lacking = [x for x in b if x not in in_a][:3]
    return took, len(rows), f"{len(a)} vs {len(b)} rows; spark only {extra}; sql only {lacking}"


def main() -> int:
    from wellpanel.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            took, n, diff = compare(spark, con, sf_dir, name, build, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            took, n, diff = 0.0, -1, f"{type(error).__name__}: {str(error)[:600]}"
        state = "no-sql" if diff is None else "ok" if not diff else "DIFF"
        bad += state == "DIFF"
        print(f"{state:7s}{name:32s}{n:8d} rows {took:6.2f}s {diff or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

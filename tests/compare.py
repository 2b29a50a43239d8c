"""Run registered queries next to their SQL twins: python -m tests.compare [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from postmatch.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def expected(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())


def main(names, sf_dir="/root/testdata/sf0.01"):
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            got, columns = rows_of(df.columns, df.collect())
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}")
            bad += 1
            continue
        took = time.time() - started
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"rows {name}: {len(got)} rows {took:.1f}s")
            continue
        try:
            want, want_columns = expected(con, sql)
        except Exception as error:
            print(f"FAIL {name}: oracle {str(error)[:600]}")
            bad += 1
            continue
        if columns != want_columns or got != want:
            bad += 1
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows; {columns} vs {want_columns}")
            missing = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else []
            extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
            print("   missing", str(missing)[:900])
            print("   extra  ", str(extra)[:900])
        else:
            print(f"ok   {name}: {len(got)} rows {took:.1f}s")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) else 0)

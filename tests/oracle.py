"""Compare every registered query with its oracle SQL. ``python tests/oracle.py [names…]``."""

from __future__ import annotations

import datetime
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sf):
    """None when both agree, else what differs."""
    df = query.run(spark, sf)
    got = rows_of(df.columns, df.collect())
    if query.oracle is None:
        return None, len(got)
    con.execute(query.oracle)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows <> {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}\n  spark  {a}\n  oracle {b}", len(got)
    return None, len(got)


def main(argv):
    from spoor.plans.registry import load
    from spoor.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    con = connect(sf)
    bad = 0
    for name, query in load().items():
        if argv and not any(a == name or a in query.covers.split() for a in argv):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, query, sf)
        except Exception as error:  # report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {query.covers:8} {name:28} {n:7} rows {time.time() - start:6.2f}s", problem or "", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

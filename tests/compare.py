"""Compare registered queries with their DuckDB statements on one data folder."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if glob.glob(os.path.join(sf_dir, name + ".parquet")):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    mine, my_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(mine)}", True
    cursor = con.execute(sql)
    theirs, their_columns = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if my_columns != their_columns:
        return f"COLUMNS {my_columns} != {their_columns}", False
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return (
            f"ROWS {len(mine)} vs {len(theirs)}\n  spark only {sorted(a - b)[:3]}\n  duck only  {sorted(b - a)[:3]}",
            False,
        )
    return f"ok {len(mine)} rows", True


def main(sf_dir, patterns):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.session import session

    spark = session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            text, good = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # keep going: the report names every failing query
            text, good = f"ERROR {type(error).__name__}: {str(error)[:900]}", False
        if not good:
            bad.append(name)
        print(f"{name:42s} {time.time() - start:6.2f}s {text}", flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

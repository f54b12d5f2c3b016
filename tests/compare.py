"""Run queries on Spark and their SQL on DuckDB and compare the rows.

``python tests/compare.py [--sf DIR] [name or prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return plain(float(value))
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.UTC).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_type(name: str) -> str:
    return {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
        "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
    }.get(name, name.upper())


def compare(spark_df, relation) -> list[str]:
    """Differences between the two results, empty if they agree."""
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} vs {sorted(relation.columns)}"]
    problems = []
    spark_types = {f.name: spark_type(f.dataType.simpleString()) for f in spark_df.schema.fields}
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types, strict=True)}
    for name in names:
        if spark_types[name] != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} vs {duck_types[name]}")
    place = [relation.columns.index(n) for n in names]
    begin = time.time()
    rows = spark_df.collect()
    compare.spark_seconds = time.time() - begin
    left = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
    right = sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
        for a, b in pairs[:2]:
            diff = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]
            problems.append(f"{len(pairs)} rows differ: {str(diff)[:400]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from textloom.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        begin = time.time()
        try:
            df = run(spark, args.sf)
            if name in sql:
                problems = compare(df, con.sql(sql[name]))
                count = f"(Spark {compare.spark_seconds:.1f}s)"
            else:
                problems, count = [], f"rows {df.count()}"
        except Exception as err:
            problems, count = ["".join(traceback.format_exception_only(err))[:900]], ""
        bad += bool(problems)
        took = time.time() - begin
        print(f"{'BAD' if problems else 'ok '} {name} {took:.1f}s {count}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

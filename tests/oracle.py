"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb

SF_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (2, "nan" if math.isnan(number) else f"{number:.9g}")
    return (3, str(value))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    """Empty text when equal, else what differs."""
    got = fn(spark, sf_dir)
    mine = [tuple(r) for r in got.collect()]
    if sql is None:
        return "" if mine else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}"
    a, b = rows_of(got.columns, mine), rows_of(columns, theirs)
    if a == b:
        return "" if a else "no rows on either side"
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return f"{len(a)} rows != {len(b)} rows; {len(bad)} differ, columns {sorted(columns)}, first {bad[:1]}"


def main() -> None:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default=SF_DIR)
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(args.sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, fn, sqls.get(name), args.sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

"""Run registered queries against their SQL twins: ``python tests/check.py [--sf DIR] [name …]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagegauge.plans.registry import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def kind(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__ if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SPENT = {"spark": 0.0}


def compare(df, con, sql):
    began = time.time()
    spark_columns, spark_rows = rows_of(df.columns, df.collect())
    SPENT["spark"] = time.time() - began
    result = con.execute(sql)
    sql_columns, sql_rows = rows_of([d[0] for d in result.description], result.fetchall())
    problems = []
    if spark_columns != sql_columns:
        return [f"columns {spark_columns} vs {sql_columns}"], len(spark_rows)
    if len(spark_rows) != len(sql_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(sql_rows)}")
    only_spark = set(map(repr, spark_rows)) - set(map(repr, sql_rows))
    only_sql = set(map(repr, sql_rows)) - set(map(repr, spark_rows))
    if only_spark or only_sql:
        problems.append(f"{len(only_spark)} only spark, {len(only_sql)} only sql")
        for label, group in (("spark", only_spark), ("sql  ", only_sql)):
            for r in sorted(group)[:3]:
                problems.append(f"  {label} {r}")
    elif spark_rows != sql_rows:
        problems.append("same distinct rows, different counts")
    for i, name in enumerate(spark_columns):
        a = {kind(r[i]) for r in spark_rows} - {None}
        b = {kind(r[i]) for r in sql_rows} - {None}
        if a and b and a != b:
            problems.append(f"type of {name}: {a} vs {b}")
    if spark_rows and not problems:
        empty = [c for i, c in enumerate(spark_columns) if all(r[i] is None for r in spark_rows)]
        if empty:
            print(f"      note: always null: {empty}")
    return problems, len(spark_rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--match", default=None)
    parser.add_argument("--module", default=None)
    args = parser.parse_args()
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pagegauge.plans import registry

    runs, sqls = entry.queries(), entry.oracle_sql()
    names = args.names or [n for n in runs if args.match is None or args.match in n]
    if args.module:
        names = [n for n in names if registry.QUERIES[n].__module__.endswith(args.module)]
    con = connect(args.sf)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = runs[name](spark, args.sf)
            if name in sqls:
                problems, n = compare(df, con, sqls[name])
            else:
                problems, n = [], df.count()
        except Exception as error:  # report and go on with the next query
            text = "".join(traceback.format_exception_only(type(error), error))
            problems, n = [text[:900]], -1
        took = time.time() - started
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {took:.1f}s (spark {SPENT["spark"]:.1f}){'' if name in sqls else ' (no sql)'}", flush=True)
        for p in problems:
            print("      " + p[:700], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

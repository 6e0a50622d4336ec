"""Run registered queries against their SQL: ``python -m tests.compare [name ...]``."""

import glob
import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = _sorted_rows(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    return got, want, dict(df.dtypes), kinds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[1:] or entry.queries():
        begin = time.time()
        try:
            got, want, spark_types, sql_types = check(spark, con, sf_dir, name)
        except Exception as exc:
            print(f"{name}: FAILED {str(exc)[:600]}")
            continue
        same = got == want
        print(f"{name}: {'ok' if same else 'DIFFERENT'} {len(got[1])}/{len(want[1])} {time.time() - begin:.1f}s")
        pairs = {c: (spark_types[c], sql_types.get(c)) for c in spark_types}
        print("   ", pairs)
        if not same:
            a, b = set(got[1]), set(want[1])
            print("   only spark", sorted(a - b)[:4], "\n   only sql", sorted(b - a)[:4], got[0], want[0])

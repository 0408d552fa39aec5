"""python tests/verify.py SF_DIR [NAME...]: runs queries and their DuckDB SQL side by side and compares all values."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (datetime, date)):
        return str(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    a = rows_of(df.columns, df.collect())
    if sql is None:
        return f"no SQL, {len(a[1])} rows"
    cur = con.execute(sql)
    b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a == b:
        return f"same, {len(a[1])} rows"
    diff = next(((x, y) for x, y in zip(a[1], b[1]) if x != y), None)
    return f"DIFFERENT: {a[0]} {b[0]} rows {len(a[1])} {len(b[1])} first {diff}"


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(sf_dir, *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf_dir), e.queries(), e.oracle_sql()
    for n in names or queries:
        t0 = time.time()
        try:
            said = compare(spark, con, sf_dir, n, queries[n], sql.get(n))
        except Exception as x:
            said = f"FAILED {type(x).__name__}: {str(x)[:600]}"
        print(f"{n}: {said} ({time.time() - t0:.1f} s)", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])

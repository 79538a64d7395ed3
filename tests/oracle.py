"""Run queries against their SQL: python tests/oracle.py [SF_DIR] [NAME …]"""

from __future__ import annotations

import datetime
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, datetime.datetime):
        return str(x.astimezone(datetime.timezone.utc).replace(tzinfo=None) if x.tzinfo else x)
    return repr(x) if isinstance(x, float) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in found)


def compare(spark, con, name, query, sql, sf_dir):
    """None if they agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows([d[0] for d in got.description], got.fetchall())
    if mine == theirs:
        return None
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} and {theirs[0]}"
    return f"{name}: {len(mine[1])} and {len(theirs[1])} rows; only here {[r for r in mine[1] if r not in set(theirs[1])][:2]}, only there {[r for r in theirs[1] if r not in set(mine[1])][:2]}"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name, sql in entry.oracle_sql().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, entry.queries()[name], sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            said = f"{name}: {type(e).__name__} {str(e)[:300]}"
        bad += said is not None
        print(f"{time.time() - began:.2f}", said or f"{name} ok", flush=True)
    print("differ:", bad)

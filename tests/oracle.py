"""Runs queries and their SQL side by side. python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        v = round(float(x), 5)
        return 0.0 if v == 0 else v
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = query(spark, sf_dir)
    a = table(got.columns, [tuple(r) for r in got.collect()])
    cur = c.execute(sql)
    b = table([x[0] for x in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} and {len(b[1])}"
    odd = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(odd)} of {len(a[1])} rows differ, as {odd[0]}" if odd else ""


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark, queries, oracles = session(), entry.queries(), entry.oracle_sql()
    for n in names or oracles:
        start = time.time()
        try:
            print(n, compare(spark, queries[n], oracles[n], sf) or "ok", f"{time.time() - start:.1f} s", flush=True)
        except Exception as e:
            print(n, "FAILED", str(e)[:600], flush=True)

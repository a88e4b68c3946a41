"""Compares registered queries with their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: With COMPARE_EXACT=1 floating-point values must be equal in every bit.
EXACT = os.environ.get("COMPARE_EXACT") == "1"


def plain(v):
    """A comparable form of a value of either engine."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0 if EXACT else float(f"{v:.9g}") + 0.0
    if hasattr(v, "to_integral_value"):
        return float(f"{float(v):.9g}")
    if type(v).__name__ == "datetime" and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    order = [cols.index(c) for c in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, sqls, bad = connection(sf), entry.oracle_sql(), []
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = spark_rows(f(spark, sf))
            took = time.time() - t
            if name in sqls:
                t = time.time()
                want = duck_rows(con, sqls[name])
                ok = got == want
                if not ok:
                    bad.append(name)
                    a, b = set(got[1]), set(want[1])
                    print("   only Spark:", got[0], sorted(a - b)[:3], "\n   only SQL:  ", want[0], sorted(b - a)[:3])
                print(f"{name}: {'same' if ok else 'DIFFERENT'} {len(got[1])} {len(want[1])} rows, {took:.1f} s, SQL {time.time() - t:.1f} s", flush=True)
            else:
                print(f"{name}: no SQL, {len(got[1])} rows, {took:.1f} s", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
    print("bad:", bad)

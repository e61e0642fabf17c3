"""Run queries beside their SQL twins and compare rows.  ``python tests/compare.py [sf] [name ...]``"""
import glob
import math
import os
import sys
import time
import traceback

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def norm(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def check(spark, con, fn, sql, sf):
    """Empty string when both sides agree, else what differs."""
    df = fn(spark, sf)
    got, names = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    want, wnames = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != wnames:
        return f"columns {names} against {wnames}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return "" if not bad else f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else SF
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), e.oracle_sql()
    failed = 0
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            why = check(spark, con, fn, sqls.get(name), sf)
        except Exception as ex:
            why = "error " + (str(ex)[:700] if "-v" not in sys.argv else traceback.format_exc())
        failed += bool(why)
        print(f"{'ok ' if not why else 'BAD'} {'sql' if name in sqls else 'row'} {time.time() - t:6.2f}s {name} {why}", flush=True)
    print("failed", failed)

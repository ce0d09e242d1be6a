"""Compare registered queries with their SQL: ``python -m tests.oracle [--sf 0.01] [name ...]``."""

import datetime
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf{}"


def session(partitions=8) -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("runlens-tests")
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.log.level", "ERROR")
            .getOrCreate())


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float, bool))
                                           else (False, "n", v) for v in r))


def compare(df, con, sql):
    """Empty string if equal, else what differs."""
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _sorted(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"\n   got  {a}\n   want {b}  ({sum(x != y for x, y in zip(got, want))} of {len(got)} rows)"
    return ""


def main(args):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    sf = "0.01"
    if args and args[0] == "--sf":
        sf, args = args[1], args[2:]
    sf_dir = DATA.format(sf)
    spark, con = session(), connection(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                verdict = f"DIFFERS {problem}" if problem else "ok"
            else:
                verdict = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__} {str(e)[:700]}"
        if verdict.startswith(("DIFFERS", "FAILED")):
            bad.append(name)
        print(f"{name:28s} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

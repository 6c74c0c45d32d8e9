"""Run registered queries against their DuckDB oracle on a test-data folder."""

from __future__ import annotations

import math
import os
import sys
import time
from glob import glob

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(x):
    if x is None:
        return None
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    return x


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = _rows(cols, cur.fetchall())
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
    elif got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        problems.append(f"rows {len(got)} vs {len(want)}; only spark {sorted(g - w)[:3]}; only sql {sorted(w - g)[:3]}")
    return problems, len(got), took


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in sqls:
                problems, n, took = compare(spark, con, name, fn, sqls[name], folder)
            else:
                t = time.time()
                n, problems = fn(spark, folder).count(), []
                took = time.time() - t
        except Exception as e:  # report and go on with the next query
            problems, n, took = [f"{type(e).__name__}: {str(e)[:1500]}"], -1, 0.0
        bad += bool(problems)
        print(("FAIL " if problems else "ok   ") + f"{name} rows={n} {took:.2f}s", *problems, flush=True)
    print("failed:", bad)

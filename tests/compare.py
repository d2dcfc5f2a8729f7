"""Run queries next to their SQL and compare schema kinds and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    return {"bool": "bool", "int": "int", "float": "float", "str": "str"}.get(type(value).__name__, type(value).__name__)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(kind(v)), v) for v in r))


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    ocols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if g != w or [kind(a) for a in g] != [kind(b) for b in w]:
            if any(isinstance(a, float) and isinstance(b, float) and math.isclose(a, b) for a, b in zip(g, w)):
                return f"(close) {g} != {w}"
            return f"{g} != {w}"[:1500]
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("TEST_TIME_ZONE"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["TEST_TIME_ZONE"])
    sf = sys.argv[1]
    con = connect(sf)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for n in names:
        t = time.time()
        try:
            r = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            r = f"{type(e).__name__}: {e}"[:1500]
        bad += r is not None
        print(f"{'ok  ' if r is None else 'FAIL'} {n} {time.time() - t:.1f}s {r or ''}", flush=True)
    print("queries", len(names), "failed", bad, "without sql", sorted(set(names) - set(entry.oracle_sql())))

"""Run queries beside their SQL and report differences.

    python -m checks.run_checks /root/testdata/sf0.01 [name part ...]
"""

from __future__ import annotations

import numbers
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tripcast-checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def tidy(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def cell(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return None
        return float(v) + 0.0 if isinstance(v, numbers.Number) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def compare(name, spark, con, sf) -> str:
    queries, sql = all_queries()
    began = time.time()
    got = queries[name](spark, sf).toPandas()
    took = time.time() - began
    if name not in sql:
        return f"rows {len(got):7d} {took:6.2f}s  {name}"
    want = con.execute(sql[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {name}: {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns)
        if got[c].dtype.kind != want[c].dtype.kind or got[c].dtype.itemsize != want[c].dtype.itemsize]
    kinds = [k for k in kinds if not {k[1], k[2]} <= {"object", "str", "string"}]
    a, b = tidy(got), tidy(want)
    if a != b:
        only_a = [x for x, y in zip(a, b) if x != y][:3]
        only_b = [y for x, y in zip(a, b) if x != y][:3]
        return (f"DIFFER {name}: {len(a)} vs {len(b)} rows, {sum(x != y for x, y in zip(a, b))} differ\n"
                f"   columns {sorted(got.columns)}\n   spark {only_a}\n   duck  {only_b}")
    note = f"  TYPES {kinds}" if kinds else ""
    return f"ok   {len(got):7d} {took:6.2f}s  {name}{note}"


def main() -> None:
    sf, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(int(os.environ.get("BENCH_CPUS", "8"))), duck(sf)
    bad = 0
    for name in all_queries()[0]:
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            line = compare(name, spark, con, sf)
        except Exception as error:  # report and go on with the other queries
            line = f"ERROR {name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not line.startswith(("ok", "rows"))
        print(line, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

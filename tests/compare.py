"""Run queries against their SQL twins on the same parquet files and compare every value."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(frame.columns)
    def text(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            v = v.tolist()
        if not isinstance(v, list) and pd.isna(v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return str(v)
    columns = [frame[n].astype(object).map(text) for n in names]
    return names, sorted(zip(*columns)) if columns else []


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    got_names, got = canonical(fn(spark, sf_dir).toPandas())
    want_names, want = canonical(con.sql(sql).df())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from plumbline.session import build_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in oracle:
                diff = compare(spark, con, queries[name], oracle[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).toPandas())
                diff = "" if n else "no rows"
        except Exception:
            diff = traceback.format_exc()[-1500:]
        failed += bool(diff)
        kind = "sql " if name in oracle else "rows"
        print(f"{'OK  ' if not diff else 'FAIL'} {kind} {time.time() - t:6.2f}s {name} {diff}", flush=True)
    print(f"{len(names) - failed}/{len(names)} equal")


if __name__ == "__main__":
    main()

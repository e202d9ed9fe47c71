"""Compare registered queries with their SQL: ``python check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from wayledger.plans.catalog import ORACLES, QUERIES
from wayledger.session import build_session
from wayledger.sources.tables import SCHEMAS


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only  {len(got):7d} rows {took:6.2f}s"
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS    {sorted(df.columns)} <> {sorted(names)}"
    if got == want:
        return f"ok         {len(got):7d} rows {took:6.2f}s"
    miss = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    return f"MISMATCH   {len(got)} vs {len(want)}\n    cols {sorted(names)}\n    only spark {extra}\n    only sql   {miss}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            result = f"ERROR      {str(exc)[:700]}"
        failed += not result.startswith(("ok", "rows-only"))
        print(f"{name:28s} {result}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

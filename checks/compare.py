"""Run queries against their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty when both sides agree exactly, else what differs first."""
    got = query(spark, sf_dir)
    rows = got.collect()
    if sql is None:
        return ""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    wanted = want.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(names)}"
    a, b = _rows(got.columns, rows), _rows(names, wanted)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)}"
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} of {len(a)} rows, first {off[0]}" if off else ""


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    chosen = args[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = sql_engine(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name, query, sql.get(name))
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok'} {kind} {name} {time.time() - start:.1f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run queries beside their SQL in DuckDB: ``python tests/compare.py [sf] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from kerbline.plans import registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def folder_of(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, folder: str, name: str):
    """``(same, n_rows, spark seconds, duckdb seconds, note)``."""
    fn, text = registry.QUERIES[name], registry.ORACLES.get(name)
    start = time.time()
    df = fn(spark, folder)
    got_columns, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return False, len(got), took, 0.0, "joins every row with every row"
    if text is None:
        return None, len(got), took, 0.0, "no SQL"
    start = time.time()
    cur = con.execute(text)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - start
    if got_columns != want_columns:
        return False, len(got), took, sql_took, f"columns {got_columns} / {want_columns}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else "?"
        lack = [r for r in want if r not in set(got)][:2] if len(want) < 50000 else "?"
        if len(got) >= 50000:
            a, b = set(got), set(want)
            extra, lack = list(a - b)[:2], list(b - a)[:2]
        return False, len(got), took, sql_took, f"rows {len(got)} / {len(want)}: +{extra} -{lack}"
    return True, len(got), took, sql_took, ""


if __name__ == "__main__":
    from kerbline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    registry.load_all()
    wanted = sys.argv[2:] or list(registry.QUERIES)
    spark, con = local_session("8"), duck(folder_of(sf))
    bad = 0
    for query in wanted:
        try:
            same, n, took, sql_took, note = check(spark, con, folder_of(sf), query)
        except Exception as error:  # noqa: BLE001
            same, n, took, sql_took, note = False, -1, 0, 0, f"{type(error).__name__}: {str(error)[:700]}"
        bad += same is False
        print(f"{'ok ' if same else '-- ' if same is None else 'BAD'} {query:32s} {n:7d} rows {took:6.2f}s sql {sql_took:5.2f}s {note}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")

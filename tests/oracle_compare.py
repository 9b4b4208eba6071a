"""Spark-vs-DuckDB comparison used by the tests and by hand.

Mirrors the driver's check: row count, column names, and an
order-insensitive comparison of values (doubles to 1e-6 relative).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb  # noqa: I001
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    if hasattr(v, "isoformat") and not isinstance(v, str):
        text = v.isoformat()[:19]
        # DATE arrives as datetime.date from Spark and as a midnight
        # timestamp from DuckDB; compare both as the date.
        return text[:10] if text[10:] in ("", "T00:00:00") else text
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(str(_norm(x)) for x in rec))
    return sorted(out)


def compare(spark, name: str, fn, sql: str, sf_dir: str, con) -> tuple[bool, str]:
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    dk = con.sql(sql).df()
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    if len(sp) != len(dk):
        return False, f"rows differ: spark={len(sp)} duck={len(dk)}"
    a, b = _rows(sp), _rows(dk)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(sp)} rows, spark {t1 - t0:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tillpoint.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]", 8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in qs:
        if only and k not in only:
            continue
        if k not in sqls:
            t0 = time.time()
            n = qs[k](spark, sf).count()
            print(f"[rows] {k}: {n} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, msg = compare(spark, k, qs[k], sqls[k], sf, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"[{'ok' if ok else 'FAIL'}] {k}: {msg}", flush=True)
    print("failures:", bad)

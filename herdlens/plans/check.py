"""Side-by-side check of a registered query against its DuckDB oracle SQL.

Usage: ``python -m herdlens.plans.check [sf_dir] [name ...]``. Compares
column names, row counts and the multiset of rows (doubles rounded to 6
digits, order-insensitive), the same shape of check the driver records.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

from herdlens.sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def duckdb_frame(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    rows = rel.fetchall()
    return cols, rows


def spark_rows(df):
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    return cols, rows


def compare(spark_cols, spark_rows_, sql_cols, sql_rows) -> tuple[bool, str]:
    if sorted(spark_cols) != sorted(sql_cols):
        return False, f"columns differ: spark={spark_cols} sql={sql_cols}"
    if len(spark_rows_) != len(sql_rows):
        return False, f"row count differs: spark={len(spark_rows_)} sql={len(sql_rows)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    qi = [sql_cols.index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in spark_rows_)
    b = Counter(tuple(_norm(r[i]) for i in qi) for r in sql_rows)
    if a != b:
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        return False, f"values differ; spark-only {only_a} sql-only {only_b}"
    return True, f"{len(spark_rows_)} rows match"


def check(spark, sf_dir: str, names=None, verbose=True) -> dict[str, tuple[bool, str]]:
    from herdlens.plans.registry import load_all

    reg = load_all()
    out = {}
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sc, sr = spark_rows(q.build(spark, sf_dir))
            if q.sql is None:
                ok, msg = True, f"rows-only: {len(sr)} rows"
            else:
                qc, qr = duckdb_frame(sf_dir, q.sql)
                ok, msg = compare(sc, sr, qc, qr)
        except Exception as e:  # report and go on
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        out[name] = (ok, msg)
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t0:6.2f}s  {msg}", flush=True)
    return out


if __name__ == "__main__":
    from herdlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = check(local_session(8), sf, set(sys.argv[2:]) or None)
    bad = [k for k, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")

"""Run registered queries against DuckDB on the same tables and compare all values."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(x):
    if x is None:
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return norm(float(x))
    return str(x)


def compare(spark, con, sf_dir, name):
    """None when equal, otherwise a description of the difference."""
    df = queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}; {cols}"
    if not got:
        return "empty result"
    return None


if __name__ == "__main__":
    from sightledger.session import build_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                bad = compare(spark, con, sf, name)
            else:
                bad = f"rows only: {queries()[name](spark, sf).count()}"
        except Exception as exc:
            bad = f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"@@ {'ok  ' if bad is None else 'FAIL'} {name} {time.time() - start:.1f}s {bad or ''}", flush=True)

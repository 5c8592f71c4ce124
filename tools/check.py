"""Run registered queries against DuckDB on the same folder: python tools/check.py FOLDER [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from rosterlab.plans import ORACLES, QUERIES  # noqa: E402
from rosterlab.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_spark("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name:36s} {len(got):8d} {took:6.2f}s")
                continue
            cur = con.execute(ORACLES[name])
            want_cols = [d[0] for d in cur.description]
            want = rows(want_cols, cur.fetchall())
            have = rows(df.columns, got)
            if sorted(want_cols) != sorted(df.columns):
                bad += 1
                print(f"BAD  {name}: columns {sorted(df.columns)} / {sorted(want_cols)}")
            elif want != have:
                bad += 1
                diff = next(((a, b) for a, b in zip(have, want) if a != b), None)
                print(f"BAD  {name}: {len(have)} / {len(want)} rows, cols {sorted(df.columns)}, first {str(diff)[:600]}")
            else:
                print(f"ok   {name:36s} {len(got):8d} {took:6.2f}s")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}")
            if names:
                traceback.print_exc(limit=4)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

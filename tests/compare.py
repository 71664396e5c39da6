"""Compares queries with their SQL in DuckDB: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6g}"
        if isinstance(x, (list, tuple)):
            return str([value(y) for y in x])
        if hasattr(x, "isoformat"):
            return x.isoformat().replace("+00:00", "")
        return str(x)

    return sorted([tuple(value(r[i]) for i in order) for r in rows]), [names[i] for i in order]


def oracle(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return canonical(got.fetchall(), names)


def main(sf_dir, names):
    import __spark_entry__ as e
    from mnemospark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
        except Exception as x:
            bad += 1
            print(name, "ERROR", str(x)[:1500], flush=True)
            continue
        s = time.time() - t
        if name not in sqls:
            print(name, "rows", len(got[0]), f"{s:.1f}s (no SQL)", flush=True)
            continue
        try:
            want = oracle(sf_dir, sqls[name])
        except Exception as x:
            bad += 1
            print(name, "SQL ERROR", str(x)[:600], flush=True)
            continue
        if got == want:
            print(name, "ok", len(got[0]), f"{s:.1f}s", flush=True)
        else:
            bad += 1
            print(name, "DIFFERS", len(got[0]), len(want[0]), got[1], want[1], f"{s:.1f}s", flush=True)
            a, b = set(got[0]), set(want[0])
            print("   only spark", list(a - b)[:4], "\n   only sql  ", list(b - a)[:4], flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))

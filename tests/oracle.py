"""Run queries on Spark and their SQL twins on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def keyed(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, sf_dir, fn, sql) -> str:
    df = fn(spark, sf_dir)
    left = keyed([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = keyed(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6)
            for x, y in zip(a, b)
        ):
            return f"{a} != {b}"
    return "" if left else "no rows"


def main() -> None:
    from plumewatch.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                result = "" if fn(spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(result)
        print(f"{'FAIL' if result else 'ok':4} {time.time() - start:6.1f}s {name} {result}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

"""Run catalogue queries in Spark and their twins in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else int(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=lambda r: [str(x) for x in r])


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf):
    """Return (ok, message)."""
    df = fn(spark, sf)
    got = rows(df.columns, df.collect())
    if sql is None:
        return True, f"rows-only {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        a, b = {str(r) for r in got}, {str(r) for r in want}
        return False, f"spark {len(got)} duckdb {len(want)}; only spark {sorted(a - b)[:3]}; only duckdb {sorted(b - a)[:3]}"
    return True, f"{len(got)} rows"


def main(sf, names):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    q, o = entry.queries(), entry.oracle_sql()
    con = connect(sf)
    bad = []
    for name in q:
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, name, q[name], o.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, "".join(traceback.format_exception_only(e)).splitlines()[0][:600]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

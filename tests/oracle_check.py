"""Compare registered Spark queries with their DuckDB oracles.

Mirrors the driver's gate: same column names, same row count, same
order-insensitive multiset of rows (values normalised to strings).
"""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb  # noqa: I001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\x00"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return h, lines


def compare(spark, name, fn, sql, sf_dir, con=None, verbose=True):
    con = con or duck(sf_dir)
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    ok = ok_cols and len(srows) == len(drows) and hs == hd
    if verbose:
        print(f"{name:24s} {'OK ' if ok else 'BAD'} rows spark={len(srows)} duck={len(drows)} "
              f"cols_ok={ok_cols} {ts:.1f}s", flush=True)
        if not ok:
            if not ok_cols:
                print("  spark cols", scols, "\n  duck cols ", dcols)
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:5]:
                print("  spark only:", x)
            for x in sorted(b - a)[:5]:
                print("  duck only: ", x)
    return ok


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from feedmerge.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    con = duck(sf)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = []
    for n, fn in qs.items():
        if names and n not in names:
            continue
        if n not in os_:
            t = time.time()
            c = fn(spark, sf).count()
            print(f"{n:24s} ROWS-ONLY {c} rows {time.time()-t:.1f}s", flush=True)
            continue
        if not compare(spark, n, fn, os_[n], sf, con):
            bad.append(n)
    print("BAD:", bad)

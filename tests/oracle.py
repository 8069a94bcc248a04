"""Compare catalogue queries with their DuckDB oracle (row multiset + column names)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, key, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    ok = ok_cols and a == b
    detail = ""
    if not ok:
        if not ok_cols:
            detail = f"cols spark={s_cols} duck={d_cols}"
        else:
            sa, sb = set(a), set(b)
            detail = (f"rows spark={len(a)} duck={len(b)} only_spark={list(sa - sb)[:3]} "
                      f"only_duck={list(sb - sa)[:3]}")
    return ok, len(s_rows), len(d_rows), t1 - t0, detail


def main(sf_dir: str, keys=None):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from rosterkit.plans import build_session
    spark = build_session()
    con = duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for k in keys or q:
        try:
            ok, ns, nd, sec, detail = compare(spark, con, k, q[k], o[k], sf_dir)
        except Exception as ex:  # noqa: BLE001
            ok, ns, nd, sec, detail = False, -1, -1, 0.0, f"{type(ex).__name__}: {str(ex)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {k:40s} spark={ns:6d} duck={nd:6d} {sec:6.2f}s {detail}",
              flush=True)
    print(f"{len(keys or q) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:] or None)

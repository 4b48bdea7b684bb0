"""Local stand-in for the driver's correctness gate: run a registered Spark query
and its DuckDB oracle on the same parquet tables; compare row count, column
names and an order-insensitive hash of normalised values.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb
import numpy as np

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in RAW:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        x = round(float(v), 6)
        return 0.0 if x == 0 else x
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _digest(rows):
    keyed = sorted(repr(r) for r in rows)
    h = hashlib.sha256()
    for k in keyed:
        h.update(k.encode())
    return h.hexdigest(), keyed


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out["duck_rows"] = len(d_rows)
    out["duck_sec"] = round(time.time() - t1, 2)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"SCHEMA {sorted(s_cols)} vs {sorted(d_cols)}"
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sn = [tuple(_norm(r[i]) for i in si) for r in s_rows]
    dn = [tuple(_norm(r[i]) for i in di) for r in d_rows]
    sh, sk = _digest(sn)
    dh, dk = _digest(dn)
    if len(sn) != len(dn):
        out["status"] = "ROWCOUNT"
    elif sh != dh:
        out["status"] = "VALUES"
    else:
        out["status"] = "ok"
    if out["status"] != "ok":
        only_s = sorted(set(sk) - set(dk))[:3]
        only_d = sorted(set(dk) - set(sk))[:3]
        out["cols"] = order
        out["only_spark"] = only_s
        out["only_duck"] = only_d
    return out


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from inkwell.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    spark = get_spark()
    con = duck_connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(names or qs)} queries, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

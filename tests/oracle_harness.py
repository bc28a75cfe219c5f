"""Run registered Spark queries and their DuckDB oracle side by side and compare.

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def close(a: list[tuple], b: list[tuple], tol=1e-6) -> bool:
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x is None or y is None:
                if not (x is None and y is None):
                    return False
            elif isinstance(x, float) or isinstance(y, float):
                if abs(float(x) - float(y)) > tol * max(1.0, abs(float(x))):
                    return False
            elif x != y:
                return False
    return True


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sorted(sdf.columns)
            stypes = dict(sdf.dtypes)
            spd = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{name:32s} SPARK ERROR {str(e)[:300]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(spd))
            if verbose:
                print(f"{name:32s} rows-only n={len(spd)} {ts:.1f}s", flush=True)
            continue
        try:
            dpd = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(f"{name:32s} SQL ERROR {str(e)[:300]}", flush=True)
            continue
        dcols = sorted(dpd.columns)
        if scols != dcols:
            results[name] = ("cols", scols, dcols)
            if verbose:
                print(f"{name:32s} COLUMNS spark={scols} sql={dcols}", flush=True)
            continue
        a, b = canon(spd), canon(dpd)
        exact = a == b
        ok = exact or close(a, b)
        results[name] = ("ok" if ok else "mismatch", len(a), len(b), exact)
        if verbose:
            print(f"{name:32s} {'OK ' if ok else 'BAD'} exact={exact} rows={len(a)}/{len(b)} {ts:.1f}s types={stypes}"
                  if not ok else f"{name:32s} OK  exact={exact} rows={len(a)} {ts:.1f}s", flush=True)
            if not ok:
                for ra, rb in list(zip(a, b))[:3]:
                    print("   spark", ra, "\n   duck ", rb)
    return results


if __name__ == "__main__":
    from chronoscope.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    compare(get_session(), sf, sys.argv[2:] or None)

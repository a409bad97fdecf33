"""Local differential check: every registered query vs its DuckDB oracle.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and the multiset of row values (doubles
compared exactly and, separately, rounded to 6 places).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from orrery.plans import catalog  # noqa: E402
from orrery.session import local_session  # noqa: E402
from orrery.sources.tables import DRIVER_TABLES  # noqa: E402


def norm(v, places=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, places) if places is not None else v
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "tolist"):
        return tuple(norm(x, places) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, places)) for k, x in v.items()))
    return v


def rows(pdf: pd.DataFrame, places=None):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pd.notna(pdf[cols]), None)
    out = [tuple(norm(v, places) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 and not argv[1].isidentifier() else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if a.isidentifier()]
    catalog.load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = catalog.ORACLES.get(name)
        if sql is None:
            print(f"{name:32s} rows={len(sp):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            dd = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(sp.columns) == sorted(dd.columns)
        exact = same_cols and rows(sp) == rows(dd)
        approx = same_cols and rows(sp, 6) == rows(dd, 6)
        status = "OK" if exact else ("APPROX" if approx else "MISMATCH")
        if not exact:
            bad += 1
        print(f"{name:32s} {status:8s} spark={len(sp):7d} duck={len(dd):7d} {ts:.1f}s")
        if not same_cols:
            print("   cols spark:", sorted(sp.columns), "\n   cols duck: ", sorted(dd.columns))
        elif not exact:
            a, b = rows(sp, 6), rows(dd, 6)
            sa, sb = set(map(repr, a)), set(map(repr, b))
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck: ", list(sb - sa)[:3])
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

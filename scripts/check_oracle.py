"""Run every registered query and its DuckDB oracle side by side; report mismatches.

Usage: python scripts/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from reviewlens.plans import catalog  # noqa: E402
from reviewlens.plans.fixtures import TABLES  # noqa: E402
from reviewlens.session import get_spark  # noqa: E402

FAMILY = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def rows(pdf, cols):
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            stypes = dict(sdf.dtypes)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"rows {k}: {len(sp)} rows ({ts:.1f}s)")
            continue
        try:
            rel = con.sql(sqls[k])
            dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
            dd = rel.df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(sp.columns) != sorted(dd.columns):
            print(f"FAIL {k}: columns {sorted(sp.columns)} vs {sorted(dd.columns)}")
            bad += 1
            continue
        cols = sorted(sp.columns)
        tmis = [(c, stypes[c], dtypes[c]) for c in cols if FAMILY.get(stypes[c], stypes[c]) != dtypes[c]]
        a, b = rows(sp, cols), rows(dd, cols)
        if len(a) != len(b):
            print(f"FAIL {k}: rows {len(a)} vs {len(b)}")
            bad += 1
            continue
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            bad += 1
            x, y = diff[0]
            print(f"FAIL {k}: {len(diff)} rows differ; first:\n   spark {str(x)[:400]}\n   duck  {str(y)[:400]}")
        else:
            print(f"ok   {k}: {len(a)} rows ({ts:.1f}s)" + (f" TYPES {tmis}" if tmis else ""))
    print("bad:", bad)


if __name__ == "__main__":
    main()

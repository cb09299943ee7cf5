"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python scripts/oracle_check.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cwescope.plans.catalog import REGISTRY  # noqa: E402
from cwescope.plans.check import compare, duck  # noqa: E402
from cwescope.session import local_session  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = local_session(8, 8)
    con = duck(a.sf)
    keys = a.keys or sorted(REGISTRY)
    bad = 0
    for k in keys:
        q = REGISTRY[k]
        t0 = time.time()
        try:
            df = q.spark_df(spark, a.sf)
            sql = q.oracle()
            if sql is None:
                n = df.count()
                print(f"ROWS {k}: {n} rows, {time.time() - t0:.1f}s (no oracle)", flush=True)
                continue
            err = compare(df, con, sql)
        except Exception as e:  # noqa: BLE001
            err = f"error {type(e).__name__}: {str(e)[:300]}"
        if err:
            bad += 1
            print(f"FAIL {k}: {err}", flush=True)
        else:
            print(f"OK   {k}: {time.time() - t0:.1f}s", flush=True)
    spark.stop()
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

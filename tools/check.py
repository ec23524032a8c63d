"""Run registered queries against their SQL on one data set and report differences and times.

usage: python tools/check.py [--sf DIR] [pattern ...]
"""

from __future__ import annotations

import argparse
import fnmatch
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aislerank.plans import registered  # noqa: E402
from aislerank.session import build_session  # noqa: E402
from aislerank.sources.driver_tables import TABLES  # noqa: E402


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    keys = frame.astype(str)
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            keys[c] = frame[c].round(7).astype(str)
    return frame.loc[keys.sort_values(list(frame.columns)).index].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind != b.dtype.kind and not (a.isna().any() or b.isna().any()):
            return f"type of {c}: {a.dtype} / {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if a.dtype.kind == "f" and b.dtype.kind == "f":
            same |= (a - b).abs() < 1e-9
        if not same.all():
            i = (~same).to_numpy().argmax()
            return f"{(~same).sum()} values of {c}, first {got.loc[i].to_dict()} / {want.loc[i].to_dict()}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("patterns", nargs="*", default=["*"])
    args = parser.parse_args()
    spark = build_session("check")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    failed = []
    for key, job in registered.QUERIES.items():
        if not any(fnmatch.fnmatch(key, p) for p in args.patterns):
            continue
        start = time.time()
        try:
            got = job(spark, args.sf).toPandas()
            spent = time.time() - start
            start = time.time()
            sql = registered.ORACLES.get(key)
            problem = difference(got, con.execute(sql).df()) if sql else None
            tag = "ok  " if sql and not problem else ("rows" if not sql else "DIFF")
        except Exception as e:  # noqa: BLE001
            problem, spent, tag, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - start, "FAIL", []
        if tag in ("DIFF", "FAIL"):
            failed.append(key)
        print(f"{tag} {key:32s} rows={len(got):7d} spark={spent:6.2f}s sql={time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

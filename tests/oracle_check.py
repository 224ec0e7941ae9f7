"""Run Spark queries and their DuckDB oracle side by side (the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
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
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                            for x in r))


def compare(spark, sf_dir: str, keys: list[str] | None = None) -> dict:
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or list(qs):
        rec = {}
        t = time.time()
        try:
            sdf = qs[k](spark, sf_dir).toPandas()
            rec["spark_rows"] = len(sdf)
            rec["spark_sec"] = round(time.time() - t, 2)
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"spark: {type(e).__name__}: {str(e)[:400]}"
            out[k] = rec
            print(k, rec, flush=True)
            continue
        if k in sqls:
            try:
                ddf = con.execute(sqls[k]).df()
                rec["oracle_rows"] = len(ddf)
                same_cols = sorted(sdf.columns) == sorted(ddf.columns)
                rec["cols"] = same_cols
                if not same_cols:
                    rec["spark_cols"] = sorted(sdf.columns)
                    rec["oracle_cols"] = sorted(ddf.columns)
                else:
                    a, b = canon(sdf), canon(ddf)
                    rec["match"] = a == b
                    if a != b:
                        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                        rec["diff"] = str(diff)[:600]
            except Exception as e:  # noqa: BLE001
                rec["error"] = f"oracle: {type(e).__name__}: {str(e)[:400]}"
        print(k, rec, flush=True)
        out[k] = rec
    return out


if __name__ == "__main__":
    from crowdlens.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if "error" in v or v.get("match") is False
           or v.get("cols") is False]
    print(json.dumps({"total": len(res), "bad": bad}))

"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python scripts/check_oracle.py [--sf /root/testdata/sf0.01] [key ...]

Prints one line per query: row counts, column-name match and whether the
order-insensitive values agree (floats compared after rounding to 9
significant digits, timestamps as text).
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

EXACT = False
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return 0.0
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, (pd.Timestamp,)):
        return str(v.to_pydatetime())
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, datetime.date):
        return str(v) + " 00:00:00"
    if hasattr(v, "item"):
        return _norm_value(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    return v


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
                 "StringType": "VARCHAR", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP",
                 "TimestampType": "TIMESTAMP WITH TIME ZONE", "BooleanType": "BOOLEAN",
                 "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def schema_diff(sdf, con, sql: str) -> list[str]:
    """Columns whose Spark type maps to a different DuckDB type."""
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in sdf.schema.fields:
        st = type(f.dataType).__name__
        want = SPARK_TO_DUCK.get(st, st)
        got = duck.get(f.name)
        if got is not None and not (got == want or (st == "DecimalType" and got.startswith("DECIMAL"))):
            out.append(f"{f.name}: spark {st} vs duckdb {got}")
    return out


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_value(x) for x in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--exact", action="store_true", help="compare floats bit for bit")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    global EXACT
    EXACT = args.exact

    from chainlake.plans.catalog import oracle_sql, queries
    from chainlake.session import get_spark

    spark = get_spark(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{args.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, orc = queries(), oracle_sql()
    keys = args.keys or sorted(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sframe = qs[k](spark, args.sf)
            sdf = sframe.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"ROWS {k}: spark rows={len(sdf)} ({ts:.1f}s, no oracle)")
            continue
        try:
            odf = con.execute(orc[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        types = schema_diff(sframe, con, orc[k])
        if types:
            print(f"TYPE {k}: " + "; ".join(types))
        same_cols = sorted(sdf.columns) == sorted(odf.columns)
        same_rows = len(sdf) == len(odf)
        same_vals = same_cols and same_rows and normalise(sdf) == normalise(odf)
        status = "OK  " if same_vals else "FAIL"
        bad += not same_vals
        print(f"{status} {k}: rows spark={len(sdf)} oracle={len(odf)} cols={'=' if same_cols else '!='} "
              f"values={'=' if same_vals else '!='} ({ts:.1f}s)")
        if not same_cols:
            print("   spark cols ", sorted(sdf.columns))
            print("   oracle cols", sorted(odf.columns))
        elif not same_vals and same_rows:
            a, b = normalise(sdf), normalise(odf)
            for ra, rb in zip(a, b):
                if ra != rb:
                    print("   first diff spark ", ra)
                    print("              oracle", rb)
                    break
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

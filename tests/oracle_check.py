"""Run queries next to their SQL oracle:  python tests/oracle_check.py [sf] [name prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object:
            df = df.assign(**{c: df[c].map(lambda v: str(v)[:10] if hasattr(v, "year") else (tuple(v) if hasattr(v, "tolist") else v))})
        elif str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype(str).str[:10]})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(set(got.columns) ^ set(want.columns))[:8]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = ordered(got), ordered(want)
    bad = []
    for c in got.columns:
        if got[c].dtype != want[c].dtype:
            bad.append(f"{c} type {got[c].dtype}/{want[c].dtype}")
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = (~same).idxmax()
            bad.append(f"{c}: {int((~same).sum())} cells, e.g. {got[c][i]!r} != {want[c][i]!r}")
    return "; ".join(bad[:6]) + (f" (+{len(bad) - 6})" if len(bad) > 6 else "")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), tables(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(x) for x in prefixes):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).df()
                msg = difference(got, want)
            else:
                msg = ""
            nulls = int(got.isna().sum().sum())
            note = f" NULLS={nulls}" if nulls else ""
            status = "FAIL " + msg if msg else ("ok" if name in sqls else "rows")
            print(f"{name:28s} {status:5s} rows={len(got)} cols={len(got.columns)} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s{note}", flush=True)
            failed += bool(msg)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"{name:28s} ERROR {str(e)[:1200]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())

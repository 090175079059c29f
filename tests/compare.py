"""Run registered queries in Spark and their SQL twins in DuckDB, and compare as multisets."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        elif kind == "object" or kind.startswith("str"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v))
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(set(got.columns) ^ set(want.columns))}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    a, b = tidy(got), tidy(want)
    found = []
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) != pd.api.types.is_float_dtype(b[c]) or pd.api.types.is_bool_dtype(a[c]) != pd.api.types.is_bool_dtype(b[c]):
            found.append(f"{c}: types {a[c].dtype} and {b[c].dtype}")
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if pd.api.types.is_float_dtype(a[c]) and pd.api.types.is_float_dtype(b[c]):
            # a value exactly between two rounded ones may fall either way: one unit of the
            # fifth digit, in at most one row of a thousand
            tie = ~same & ((a[c] - b[c]).abs() <= 1.1e-5)
            if tie.sum() <= max(1, len(a) // 1000):
                same = same | tie
        if not same.all():
            at = (~same).idxmax()
            found.append(f"{c}: {int((~same).sum())} differ, e.g. {a.loc[at].to_dict()} / {b.loc[at].to_dict()}")
    return found


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tickloom.session import local_session

    folder = "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark {str(exc)[:600]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got)} in {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(oracles[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb {str(exc)[:600]}", flush=True)
            bad.append(name)
            continue
        diff = differences(got, want)
        if diff:
            bad.append(name)
        print(f"{'FAIL' if diff else 'ok'} {name}: {len(got)} rows, spark {t1 - t0:.1f}s, duckdb {time.time() - t1:.1f}s {'; '.join(diff)[:900]}", flush=True)
    print("failed:", bad)

"""Compare a query with its oracle SQL, row for row in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    return float(f"{float(v):.9g}")


def rows(df):
    return sorted((tuple(_value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def check(spark, con, query, sql, folder):
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

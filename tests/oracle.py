"""Compares a query with its SQL in DuckDB, as the driver does: columns by name, values by text, rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "None"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(text, v)) + "]"
    return repr(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(map(text, r)) for r in df.itertuples(index=False, name=None))


def same(query, sql, spark, folder):
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

"""Rows of Spark and DuckDB in one form."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT:
        return "NULL"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}"
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).tz_localize(None).isoformat()
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())

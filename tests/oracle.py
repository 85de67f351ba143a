"""A Spark query against its SQL on DuckDB, rows as a multiset."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    columns = sorted(df.columns)
    return sorted((tuple(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


def same(spark, query, sql: str, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

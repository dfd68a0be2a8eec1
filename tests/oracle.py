"""Compares a query with its DuckDB oracle, order and small float noise aside."""

import os

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(text, r)) for r in df.itertuples(index=False)), key=str)


def duck(sf: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c.execute(sql).fetch_df()


def check(spark, sf: str, query, sql: str) -> None:
    a, b = query(spark, sf).toPandas(), duck(sf, sql)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)

"""Compare a query's rows with its oracle SQL in DuckDB, as multisets by column name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def assert_same(df, sql, con):
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(map(_cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(_cell(r[i]) for i in at) for r in want.fetchall())

"""Rows of a Spark query against DuckDB's of its SQL."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(path=DATA):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{path}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def same(df, sql, path=DATA):
    result = connection(path).sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(result.columns, result.fetchall())
    assert len(got) == len(want)
    assert got == want

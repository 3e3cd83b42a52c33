"""Rows of a query and of its SQL in DuckDB, in one order."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def both(spark, con, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect()), sorted(str(tuple(r[i] for i in at)) for r in told.fetchall())

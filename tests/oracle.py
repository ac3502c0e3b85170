"""Holds a query's rows against those of its SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of(found):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found)


def holds(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({sql}) t").fetchall()
    assert rows_of(df.select(*columns).collect()) == rows_of(expected)

"""A query's result against its DuckDB twin on the same tables."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf}/{t}.parquet*"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=str)


def same(spark, build, sql, sf=SF):
    df = build(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]

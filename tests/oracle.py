"""Rows of a query and of its SQL, made comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(query, sql, spark, sf):
    df = query(spark, sf)
    got = connection(sf).sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    mine, theirs = comparable(df.columns, map(tuple, df.collect())), comparable(got.columns, got.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs

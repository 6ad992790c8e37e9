"""Comparing a query with its DuckDB text on the given tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    rows = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql.strip().rstrip(';')}) q").fetchall()
    return names, sorted((tuple(map(plain, r)) for r in rows), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)


def same(df, sql, sf_dir):
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not bad, (len(bad), bad[:3])

"""Compares a query with its SQL on benchmark tables, the smallest ones unless said otherwise, as multisets of rows."""

import os

import duckdb

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HAVE = os.path.isdir(SF)


def rows_equal(spark, query, sql, sf=SF):
    df = query(spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()
    text = lambda rows: sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = text(df.select(*names).collect())
    assert got == text(want)
    return len(got)

"""Compares a query with its SQL: same columns, same rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf, run, sql):
    frame = run(spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        rel = c.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(x) for x in columns]
        want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got == want

"""Compares a Spark result with DuckDB's, as sets of rows with multiplicity."""

import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return Counter(map(repr, clean.itertuples(index=False, name=None)))


def assert_same(df, sql, sf):
    ours, theirs = df.toPandas(), connect(sf).sql(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])

"""Runs a query and its SQL on the same tables and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def same(df, sql, sf):
    names = sorted(df.columns)
    ours = sorted(tuple(_value(r[n]) for n in names) for r in df.collect())
    found = connection(sf).sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    theirs = sorted(tuple(_value(r[i]) for i in at) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs

"""Compares a query with its SQL on the same tables."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_by_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def assert_same(df, sql, sf_dir):
    names, want = rows_by_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert Counter(str(tuple(r)) for r in df.collect()) == Counter(str(tuple(r[i] for i in order)) for r in want)

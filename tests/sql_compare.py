"""Runs a query and its SQL on the same tables and compares them as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(df, sql, con):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])

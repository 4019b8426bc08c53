"""Holds a query against its SQL: columns by name, rows in any order, numbers to six places."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def agree(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    relation = con.sql(sql)
    names = sorted(relation.columns)
    assert sorted(df.columns) == names
    at = [relation.columns.index(c) for c in names]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in relation.fetchall())
    got = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not off, off[:3]

"""Rows of a Spark query and of DuckDB SQL, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def same(df, sql: str, sf_dir: str) -> None:
    names = sorted(df.columns)
    rows = sorted(tuple(map(_plain, r)) for r in df.select(*names).collect())
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())

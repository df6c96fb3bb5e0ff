"""Holds a query's rows against DuckDB's."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE"}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return str(v) if v is not None else None


def rows_of(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else str(x) for x in r))


def compare(df, sql, con):
    names = sorted(df.columns)
    mine = rows_of(tuple(normal(r[c]) for c in names) for r in df.select(*names).collect())
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    theirs = rows_of(tuple(normal(r[i]) for i in at) for r in found.fetchall())
    assert mine == theirs

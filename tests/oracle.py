"""Holds a query's rows against DuckDB SQL over the same tables."""

from pathlib import Path

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = Path("/root/testdata/sf0.001")


def connection():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("the driver tables are not here")
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def hold(spark, query, sql):
    frame = query(spark, str(FOLDER))
    expected = connection().sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(expected.columns)
    mine = sorted(repr(tuple(str(plain(r[n])) for n in names)) for r in frame.collect())
    theirs = sorted(repr(tuple(map(str, map(plain, r)))) for r in expected.select(*(f'"{n}"' for n in names)).fetchall())
    assert mine == theirs

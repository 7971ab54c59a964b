"""Every query that has SQL gives the rows that DuckDB gives; the rest run and have rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from sediment import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf, name):
    df = plans.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    got = duck.execute(plans.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in order)) for r in rows) == want

"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from brooklog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are elsewhere")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in catalog.ORACLES:
        assert got
        return
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=key)
    assert sorted(names) == columns
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

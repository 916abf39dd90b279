"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from metaloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return f"[{','.join(map(plain, v))}]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        order = sorted(df.columns)
        at = [want.columns.index(c) for c in order]
        assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns and set(QUERIES) <= set(entry.queries())

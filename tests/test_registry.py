"""Every query with SQL against DuckDB on the smallest tables; the others for rows and a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell import registry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in NAMES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert got.columns and got.count() >= 0
        return
    want = db.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda rs, names: sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in rs), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

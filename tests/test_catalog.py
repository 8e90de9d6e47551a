"""Every catalogued query against DuckDB on the smallest tables, or at least for a stable schema."""

import duckdb
import pytest

from brackwater.plans import catalog

catalog.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r.values()) for r in table.select(names).to_pylist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toArrow()
    want = duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0

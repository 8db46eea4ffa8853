"""Every query of the catalogue against its SQL, over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(spark, duck, query, sql):
    import pandas as pd

    rows = query(spark, SF).toPandas()
    want = duck.sql(sql).df()
    assert sorted(rows.columns) == sorted(want.columns) and len(rows) == len(want)
    columns = sorted(rows.columns)

    def plain(df: pd.DataFrame) -> list:
        return sorted(df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None), key=str)

    for a, b in zip(plain(rows), plain(want)):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 1e-6) for x, y in zip(a, b)), (a, b)


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        from lumisift import catalogue

        metafunc.parametrize("name", sorted(catalogue.QUERIES))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_equals_its_sql(spark, duck, name):
    from lumisift import catalogue

    assert name in catalogue.SQL
    same(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

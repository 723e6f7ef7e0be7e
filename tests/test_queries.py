"""Every registered query against its SQL on the small tables."""

import glob
import math
import os

import pytest

from lodestack.plans import catalog

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, tables, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = tables.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_entry_points(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["literal_search"](spark, small).columns

"""The driver contract: what queries() and oracle_sql() promise. Every SQL text parses, and all but the fits' are compared."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import catalog

DATA = "/root/testdata/sf0.001"
COMPARED = sorted(n for n in catalog.ORACLES if not n.endswith("_fit"))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_sql_text_parses(con):
    for name, sql in entry.oracle_sql().items():
        try:
            con.execute(f"EXPLAIN {sql}")
        except duckdb.Error as e:
            pytest.fail(f"{name}: {e}")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert key(got.astype(want.dtypes.to_dict())) == key(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

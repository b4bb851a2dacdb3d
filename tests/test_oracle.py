"""Every query with SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

from quillstat.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(([repr(x) for x in r] for r in rows))
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["name"] for r in rows][:3] == ["l_quantity", "l_extendedprice", "l_linestatus"]
    assert set(SQL) <= set(__spark_entry__.queries())

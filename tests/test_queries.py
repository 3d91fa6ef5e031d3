"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import os

import pytest

from slotwise.plans import registry

DATA = "/root/testdata/sf0.001"


def typed(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({registry.oracle_sql()[name]})").fetchall()
    have = [tuple(typed(v) for v in r) for r in got.select(*names).collect()]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(have, key=key) == sorted((tuple(typed(v) for v in r) for r in want), key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_has_rows(spark):
    found = registry.flagship(spark, DATA)
    assert found.count() == 15 and found.columns[0] == "rank"

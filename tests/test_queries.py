"""Each registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from rankloom.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in rows)
    result = con.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want

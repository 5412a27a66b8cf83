"""Each query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from siftwell.plans import stored_queries  # noqa: F401  adds its queries
from siftwell.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(columns, values):
    def plain(v):
        return f"{v:.6f}" if isinstance(v, float) else repr(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    found = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert found
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, found) == rows(columns, want.fetchall())

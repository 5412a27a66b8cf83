import os

import duckdb
import pytest

from siftwell.llm.queries import ORACLE_SQL, QUERIES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    got, want = QUERIES[name](spark, sf_dir), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_sharding_query_names_its_law(spark, sf_dir):
    got = QUERIES["op5_sharding"](spark, sf_dir).collect()
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}

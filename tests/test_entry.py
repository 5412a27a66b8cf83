import importlib.util

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80
    training = importlib.util.find_spec("siftwell.llm") is not None
    assert training == ("pipeline" in queries) == any(name.startswith("op8_") for name in queries)

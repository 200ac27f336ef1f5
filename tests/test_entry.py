import __spark_entry__ as e


def test_contract(spark):
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) and s.strip() for s in oracles.values())


def test_flagship(spark):
    rows = e.entry(spark)
    assert rows.columns == ["lock_id", "exit_code", "noisy"] and rows.count() > 0

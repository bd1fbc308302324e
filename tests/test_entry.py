import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 50 and set(o) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

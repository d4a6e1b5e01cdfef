import __spark_entry__ as entry


def test_names_and_sql_match():
    q, sql = entry.queries(), entry.oracle_sql()
    assert q and set(sql) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

import __spark_entry__ as e


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(e.oracle_sql()) <= set(e.queries())

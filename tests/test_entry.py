import __spark_entry__ as entry


def test_queries_and_sql_have_names_in_common():
    assert set(entry.oracle_sql()) <= set(entry.queries())

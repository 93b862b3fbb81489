import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names

import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"method", "n"}


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

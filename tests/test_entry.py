import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "answer"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

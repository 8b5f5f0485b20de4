import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 60

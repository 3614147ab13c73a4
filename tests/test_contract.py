import __spark_entry__ as contract


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["category", "success_rate"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 160

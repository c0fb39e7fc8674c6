"""The driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rule" in df.columns


def test_every_oracle_has_a_query():
    queries, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) >= 120 and len(oracle) >= 110

"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"base_asset", "is_trading", "trades", "volume", "turnover", "vwap"}


def test_every_twin_belongs_to_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 130

"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["t_ns", "val"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50

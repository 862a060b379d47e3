import __spark_entry__ as entry


def test_registry(spark):
    names = entry.queries()
    assert {"A1_dedup_conflict", "J4_resolution", "P12_notation", "E1_stability"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0

import __spark_entry__ as entry


def test_entry(spark):
    (row,) = entry.entry(spark).collect()
    assert 0 <= row["iou"] <= row["dice"] <= 1 and row["total"] > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

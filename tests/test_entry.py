import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["a", "b", "together"]
    df.collect()

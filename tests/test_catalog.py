import pytest

from weir.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(name, spark, sf, same):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_twice_alike(name, spark, sf):
    a, b = (sorted(map(repr, catalog.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

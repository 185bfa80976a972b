import pytest

from fieldloom.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small_dir, name):
    assert_same(spark, small_dir, name, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, small_dir, name):
    frame = QUERIES[name](spark, small_dir)
    assert frame.count() > 0
    assert len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

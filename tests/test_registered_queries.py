"""Every registered query against its SQL."""

import __spark_entry__ as entry
import harness
import pytest

SQL = entry.oracle_sql()


def test_every_query_has_sql():
    from tablewise.workloads import all_queries

    assert set(all_queries()) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    assert harness.compare(spark, con, sf_dir, entry.queries()[name], SQL[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_id", "customer_id", "order_status", "amount", "order_date", "priority_level"]
    df.collect()

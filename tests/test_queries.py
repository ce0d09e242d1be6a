"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    assert compare(entry.queries()[name](spark, sf), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "name", "samples", "mean_rate", "peak_rate"] and df.count() > 0

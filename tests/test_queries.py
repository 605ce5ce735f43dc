"""Every query with SQL equals it; every query runs."""

import pytest

import __spark_entry__
from tests.oracle import connect, differences
from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    if name in plans.oracle_sql():
        extra, missing = differences(df, plans.oracle_sql()[name], duck)
        assert not extra and not missing, (extra[:3], missing[:3])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

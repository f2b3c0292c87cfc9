"""Every query with SQL agrees with it on the smallest tables."""

import pytest

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def names():
    from quarry.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_equal(spark, con, name):
    from quarry.plans import catalog

    assert oracle.compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 50


def test_queries_without_sql(spark):
    from quarry.plans import catalog

    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0

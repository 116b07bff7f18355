"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from compare import assert_same

from vellumic import plans

ORACLES = plans.oracles()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(df, ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_oracles_are_of_queries():
    assert set(ORACLES) <= set(plans.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())

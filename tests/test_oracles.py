"""Every registered query of the library against its SQL."""

import pytest
from oracle import assert_same
from plumeworks import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert assert_same(spark, plans.QUERIES[name], plans.ORACLES[name], "/root/testdata/sf0.001") > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

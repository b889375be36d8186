"""The queries that SQL can express, against it."""

import pytest
from oracle import assert_same
from plumeworks.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert assert_same(spark, llm.QUERIES[name], llm.ORACLES[name], "/root/testdata/sf0.001") > 0

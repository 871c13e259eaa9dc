"""Every query of the registry against its SQL on the smallest tables."""

import os

import pytest

from signalloom.plans.registry import ORACLE_SQL, QUERIES

from .oracle import assert_same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)

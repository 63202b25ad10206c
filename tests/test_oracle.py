"""Every registered query against its SQL on the smallest given tables."""

import pytest

from checks import QUERIES
from checks.compare import differences, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, oracle, name):
    fn, sql = QUERIES[name]
    if sql is None:
        assert fn(spark, SF_DIR).count() >= 0
    else:
        assert differences(spark, oracle, fn, sql, SF_DIR) is None

"""Every registered query against its check SQL on the smallest tables."""

import oracle
import pytest

from prospectry.catalog.all import CHECK_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(CHECK_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    assert oracle.compare(name, QUERIES[name], CHECK_SQL[name], spark, con, sf) == ""

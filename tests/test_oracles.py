"""Every registered reference and relational query against its SQL."""

import pytest
from compare import database, same

from weftline.plans import catalogue, oracles


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    same(catalogue.QUERIES[name](spark, sf), con, oracles.ORACLES[name])

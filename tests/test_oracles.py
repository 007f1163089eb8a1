"""Every registered query against its SQL on the driver's tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from verification.compare import compare, connect
from verification.registry import COVERS, ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from lexiloom.plans import ORACLES, QUERIES
from tests.harness import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(name, spark, SF_DIR, con)
    assert ok, message


def test_twins_name_existing_queries():
    assert set(ORACLES) <= set(QUERIES)

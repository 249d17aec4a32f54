"""Every registered query against its SQL form."""

import os

import pytest

import oracle
from evlake.plans import ORACLES, QUERIES

SF = os.environ.get("EVLAKE_TEST_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert oracle.compare(spark, SF, QUERIES[name], ORACLES[name], con) is None
    else:
        assert QUERIES[name](spark, SF).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

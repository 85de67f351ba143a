"""Every registered query of the library proper against its oracle."""

import pytest

from orrery.plans import ORACLES, QUERIES
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    assert df.count() > 0

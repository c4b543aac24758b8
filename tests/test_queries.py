"""Each query of the reference's operators against its SQL; those without are held against their own checks elsewhere."""

import pytest
from conftest import DATA, normal
from pandas.testing import assert_frame_equal

from tidemark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count()

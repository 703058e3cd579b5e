"""Every registered query on the smallest tables, against its SQL."""

import pytest

from foliant.plans import registered
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered()[0]))
def test_query(spark, con, name):
    out = compare(spark, con, name, SF)
    assert out.startswith(("ok", "rows", "EMPTY 0 ")), out

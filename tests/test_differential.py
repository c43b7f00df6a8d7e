"""Every catalogue query against the oracle."""

import pytest

from tests.compare import assert_same
from tidemill.queries import ALL


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, sf_dir, oracle):
    assert ALL[name].oracle
    assert_same(ALL[name].run(spark, sf_dir), oracle, ALL[name].oracle)

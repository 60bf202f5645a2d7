"""Every query over session histories against its SQL."""

import pytest
from oracle import differences

from loglattice.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert differences(registry.queries()[name](spark, small), registry.oracle_sql()[name], small) == []

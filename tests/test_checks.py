"""Every registered query against its SQL counterpart."""

import oracle
import pytest
from conftest import SF

from codesift.plans.registry import CHECKS


@pytest.mark.parametrize("key", list(CHECKS))
def test_check(spark, con, key):
    check = CHECKS[key]
    rows, why = oracle.compare(check.run(spark, SF), con, check.sql)
    assert not why, why
    assert rows >= 0

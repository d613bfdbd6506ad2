"""Every registered query of the core library against its oracle."""

from __future__ import annotations

import pytest

from auctra.plans import queries as core
from tests.oracle import differences

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0

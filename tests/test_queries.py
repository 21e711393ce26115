from __future__ import annotations

import pytest

from tests.oracle import assert_same
from tidewell.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_oracle(spark, sf, name):
    assert_same(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

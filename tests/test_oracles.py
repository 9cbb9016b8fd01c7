"""Every registered query of the matching operators against its DuckDB oracle."""

from __future__ import annotations

import pytest

from fleetmatch.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every named query against its SQL on the smallest tables."""

import pytest
from harness import compare, connect

from replenish.plans.catalog import REGISTRY


# queries that SQL can't express; each has a test of its own
ROWS_ONLY = {
    "inv17_policy", "inv18_apply_policy", "fc2_seasonal_smoothing", "fc3_two_week_autoregression", "fc4_change_points", "fc10_validation_errors",
    "uq4_quantile_regression", "uq4_interval_coverage",
}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("key", [key for key in REGISTRY if key not in ROWS_ONLY])
def test_matches_sql(spark, folder, con, key):
    ok, detail = compare(spark, key, REGISTRY[key], folder, con)
    assert ok, detail
    assert "TYPES" not in detail, detail


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(REGISTRY) - set(entry.oracle_sql())
    assert set(REGISTRY) <= set(entry.queries())
    assert without == ROWS_ONLY

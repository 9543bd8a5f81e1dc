"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from dyadscope.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose answer has no rows on the smallest tables.
EMPTY_HERE = {"run_page"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert verdict in ("", "both sides are empty") if name in EMPTY_HERE else verdict == "", verdict


def test_entry_has_rows(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert "candidate_tier" in df.columns and df.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

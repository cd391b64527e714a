"""Every registered query against its SQL."""

import check
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from tidegraph.plans import catalog

catalog.load_all()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert name in ORACLES
    assert check.differences(df, con, ORACLES[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

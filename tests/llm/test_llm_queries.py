"""The registered queries that SQL can express, against their SQL."""

import check
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from tidegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert check.differences(df, check.connect(SF_DIR), queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)

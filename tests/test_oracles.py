"""Every registered query against DuckDB."""

import os

import oracle
import pytest

from scenelake.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("SCENELAKE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert oracle.compare(df, con, ORACLES[name]) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)

"""The registered queries against DuckDB; those without SQL give rows, and have brute force elsewhere."""

import os

import oracle
import pytest

from scenelake.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("SCENELAKE_SF_DIR", "/root/testdata/sf0.01")
#: Merges, trained likelihoods, votes of neighbours, trained weights and eigenvectors aren't SQL.
WITHOUT = {"op1_byte_bpe", "op6_language_id", "op7_toxicity", "op8_url_filters", "op12_whitening", "op13_bytenet"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert oracle.compare(df, oracle.connect(SF_DIR), ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_only_these_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == WITHOUT

"""Registered queries against their oracles on whole small tables."""

import pytest
from conftest import oracle, same_as_oracle

from spanmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_oracle(spark, name):
    same_as_oracle(spark, oracle("sf0.001"), queries.QUERIES[name], queries.ORACLES[name], "sf0.001")


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)

"""Every query of the library against its oracle on the smallest tables; the others for rows and a stable schema."""

import pytest
from conftest import DATA, oracle, same_as_oracle

from spanmill.plans import catalog

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    same_as_oracle(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/{SF}")
    assert df.collect()
    assert df.schema == catalog.QUERIES[name](spark, f"{DATA}/{SF}").schema


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert sorted(r["band"] for r in e.entry(spark).collect()) == ["4to6", "6to8", "over8", "under4"]
    assert set(e.oracle_sql()) <= set(e.queries())

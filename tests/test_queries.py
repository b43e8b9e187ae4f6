"""Every registered query against its DuckDB oracle on sf0.001 (the
driver's correctness gate, at the smallest scale)."""

import pytest

import __spark_entry__ as E
from feedmerge.plans.catalog import REGISTRY
from conftest import SF_SMALL
from oracle_check import compare, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    """All but the corpus queries that SQL cannot express (tests/llm has those)."""
    assert set(ORACLES) <= set(QUERIES)
    assert set(REGISTRY) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], SF_SMALL, con, verbose=True)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["tenant_id", "sku", "vendor_id", "quantity_available", "lead_time_days", "cost",
                          "map_price", "price", "condition", "updated_at"]

"""The driver's correctness gate, locally: Spark query vs DuckDB oracle.

Runs every key with an oracle at sf0.01, and the smoke entry on sf0.001.
"""

import pytest

import __spark_entry__ as E
from conftest import SF01
from oracle_compare import compare, duck
from tillpoint.plans import registry

# The reference's own queries; tests/llm holds the training-data operators.
KEYS = list(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_is_registered():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "revenue" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, small_trees, key):
    ok, msg = compare(spark, key, registry.queries()[key], registry.oracle_sql()[key], SF01, con)
    assert ok, msg

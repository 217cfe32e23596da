"""Every registered query against its SQL on the smallest tables."""

import pytest

from tessera.plans.registry import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    out = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(out, ORACLES[name], sf)
    else:
        assert out.columns and out.collect()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query against its SQL on the smallest tables; those without SQL give rows."""

import pytest

from tests.compare import against_sql
from tracewell.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, name):
    got, want = against_sql(QUERIES[name](spark, sf), ORACLES[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

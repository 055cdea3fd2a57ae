"""Every catalogued query against its SQL on the smallest tables, or for a stable schema where SQL has no word for it."""

import pytest

from cloneloom.plans import catalogue
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

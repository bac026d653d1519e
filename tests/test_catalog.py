"""Every query with SQL against DuckDB; every other one runs, and those that prune are held against all pairs."""

import oracle
import pytest

from strandgrid.plans import catalog

SLOW = {"lev_within_small", "distance_table", "all_distances", "distance_table_rft", "contig_search", "probe_calibration"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    oracle.compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

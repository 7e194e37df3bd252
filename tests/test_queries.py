"""Every query with SQL gives the same rows and columns as that SQL in DuckDB."""

import pytest
from compare import duck_rows, spark_rows

import __spark_entry__ as entry
from tidemark.plans import catalogue, network, places, raster, roads, samples, streams

QUERIES = {n: q for m in (raster, catalogue, network, samples, places, streams, roads) for n, q in m.lens.queries.items()}
SQL = {n: q for m in (raster, catalogue, network, samples, places, streams, roads) for n, q in m.lens.sql.items()}
SMALL_BUDGET = {"s_largest_remainder", "s_seeded_pick", "s_manifest_digest"}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(SQL) - SMALL_BUDGET))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(SQL[name], sf_dir)


def test_budget_above_the_total_is_an_error(spark, sf_dir):
    with pytest.raises(ValueError, match="budget"):
        QUERIES["s_largest_remainder"](spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(SQL) & SMALL_BUDGET))
def test_sampling_equals_sql(spark, name):
    at = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES[name](spark, at)) == duck_rows(SQL[name], at)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

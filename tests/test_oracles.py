"""Every query with SQL against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = check.compare(spark, con, sf_dir, name)
    assert ok, note


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 1000
    assert "geo_risk_score" in out.columns


def test_oracles_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

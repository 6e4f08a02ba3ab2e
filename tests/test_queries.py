"""Every registered query against its SQL on DuckDB, on the smallest given tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from vellum.catalog import load_all

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, message, _ = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(load_all()) - set(SQL)))
def test_gives_rows(spark, name):
    """What SQL cannot state is tested on rows elsewhere; here it runs whole, twice with the same rows."""
    first, again = ([tuple(map(str, r)) for r in QUERIES[name](spark, SF).collect()] for _ in range(2))
    assert first and sorted(first) == sorted(again)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_inventory_ids_are_well_formed():
    for e in load_all().values():
        assert e.covers and all(re.fullmatch(r"[A-Z]{2}-\d+[a-f]?", c) for c in e.covers), e.name

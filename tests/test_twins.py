"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tests.twins import compare, duck


@pytest.fixture(scope="module")
def database():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_its_sql(spark, database, name):
    good, note = compare(spark, database, SMALL, name)
    assert good, note


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

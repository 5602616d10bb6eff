"""Every registered query over the star schema against its SQL twin on the same files."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from concordat.plans import star_schema
from oracle import ORACLE
from tests.sql_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(star_schema.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(contract.queries()[name](spark, sf_dir), con, contract.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert star_schema.QUERIES.keys() == ORACLE.keys()
    assert ORACLE.keys() <= contract.queries().keys()

"""Queries that SQL can express, against their SQL on the same files."""

from __future__ import annotations

import pytest

from concordat.llm.oracle import ORACLE
from concordat.llm.queries import QUERIES
from tests.sql_check import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None

"""Every registered query with a SQL twin equals it on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_every_query_has_a_twin_or_is_iterative():
    own = {n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(oracle_sql()) == {"resolve_entities"}


def test_flagship(spark):
    rows = entry(spark).collect()
    assert len(rows) == 400 and {r.status for r in rows} == {"decided"}

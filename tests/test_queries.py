"""Every registered query with SQL agrees with it; those without are held against NumPy in test_query_values.py."""

import os
import re

import pytest

from sparkreg.jobs import registry
from tests.oracle import agree

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, small, name):
    agree(QUERIES[name](spark, small), SQL[name], small)


def test_every_query_has_values_to_be_held_against():
    with open(os.path.join(os.path.dirname(__file__), "test_query_values.py")) as f:
        named = set(re.findall(r'"([a-z_0-9]+)"', f.read()))
    named |= {f"{k}_spanning_{s}" for k in ("minimum", "maximum") for s in ("forest", "tree")}
    assert set(QUERIES) - set(SQL) <= named

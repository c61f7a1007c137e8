"""Every catalog query with a SQL twin agrees with it on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E
from check import compare, connect
from conftest import SMALL

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    assert compare(spark, db, SMALL, name, E.queries()[name], ORACLES[name]) is None


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())

"""Every registered query against its oracle SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry
from oracle import compare, duck

from sqlcorpus.plans.oracles import oracle_sql
from sqlcorpus.plans.queries import QUERIES as OWN

QUERIES, ORACLES = {name: entry.queries()[name] for name in OWN}, oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLES[name]) is None

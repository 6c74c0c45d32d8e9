"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import oracle
from seriespan import registry

registry.load()
FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

# Queries that rightly find nothing in the smallest tables.
NONE_HERE = {"detector_boost_overshoot"}
NAMES = sorted(n for n in registry.ORACLES if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problems, rows, _ = oracle.compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], FOLDER)
    assert not problems
    assert rows > 0 or name in NONE_HERE


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

"""Every catalogue query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check_catalog import compare, connect

from tidemark.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, note

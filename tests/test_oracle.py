"""Registered queries against their SQL on the smallest driver tables."""

from pathlib import Path

import pytest

from workload import registry
from workload.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"
ORACLES = registry.oracles()
NAMES = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, connection, name):
    assert difference(spark, connection, FOLDER, registry.callables()[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.callables())
    assert len(registry.callables()) > 90


def test_every_query_has_an_oracle():
    assert set(registry.callables()) == set(ORACLES)

"""Every query key against its SQL on whole tables, by column names, types and values."""

import pytest
from compare import connect, duckdb_result
from conftest import SMALL

import __spark_entry__ as entry_point
import oracle
from orderlens import registry


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_key_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("key", list(registry.queries()))
def test_key(answers, duck, key):
    kinds, expected = duckdb_result(duck, oracle.oracle_sql()[key])
    spark_kinds, found, _ = answers[key].result()
    assert spark_kinds == kinds
    assert found == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0

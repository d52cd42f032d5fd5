"""Every query against its SQL: on the given tables, on hot and broken keys, and
with no side small enough to broadcast."""

from __future__ import annotations

import pytest
from check_oracle import differences, duck
from conftest import SMALL

import __spark_entry__ as entry
from ledgerlake.plans import checks

QUERIES = checks.queries()
SQL = checks.oracle_sql()


@pytest.fixture(scope="module")
def small_db():
    return duck(SMALL)


@pytest.fixture(scope="module")
def hot_db(hot_dir):
    return duck(hot_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_given_tables(spark, small_db, name):
    assert differences(QUERIES[name](spark, SMALL), small_db, SQL[name]) is None


@pytest.mark.parametrize("name", QUERIES)
def test_hot_and_broken_keys_without_broadcast(spark, conf, hot_db, hot_dir, name):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    assert differences(QUERIES[name](spark, hot_dir), hot_db, SQL[name]) is None

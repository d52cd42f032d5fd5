from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from ledgerlake.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", {
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        # The tables are tiny; without this every write would be a single task.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_(**settings):
        for key, value in settings.items():
            name = key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield set_
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="session")
def hot_dir(tmp_path_factory):
    """The small tables with hot keys and broken links: a third of the lines on one
    order and a third on one part, a third of the orders on one customer, most parts
    in one category, keys far apart, and lines, orders and customers whose order,
    part, customer or nation does not exist."""
    out = tmp_path_factory.mktemp("hot")
    db = duckdb.connect()
    source = {
        "lineitem": """
            SELECT * EXCLUDE (n) REPLACE (
                CASE WHEN n % 3 = 0 THEN 7 WHEN n % 50 = 1 THEN 88888888 ELSE l_orderkey * 1000003 END AS l_orderkey,
                CASE WHEN n % 3 = 1 THEN 11 WHEN n % 50 = 2 THEN 77777777 ELSE l_partkey END AS l_partkey,
                CASE WHEN n % 41 = 0 THEN 0 ELSE l_quantity END AS l_quantity
            ) FROM (SELECT *, row_number() OVER () AS n FROM '{0}')""",
        "orders": """
            SELECT * REPLACE (
                CASE WHEN o_orderkey = 1 THEN 7 ELSE o_orderkey * 1000003 END AS o_orderkey,
                CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 50 = 1 THEN 66666666
                     ELSE o_custkey END AS o_custkey
            ) FROM '{0}'""",
        "customer": """
            SELECT * REPLACE (CASE WHEN c_custkey % 20 = 5 THEN 99 ELSE c_nationkey END AS c_nationkey)
            FROM '{0}'""",
        "part": """
            SELECT * REPLACE (CASE WHEN p_partkey % 2 = 0 THEN 'STANDARD' ELSE p_type END AS p_type)
            FROM '{0}'""",
        "nation": "SELECT * FROM '{0}'",
    }
    for name, sql in source.items():
        db.execute(f"COPY ({sql.format(f'{SMALL}/{name}.parquet')}) TO '{out}/{name}.parquet'")
    return str(out)

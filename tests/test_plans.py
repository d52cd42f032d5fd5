"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from check_oracle import duck, rows_of
from conftest import SMALL

from ledgerlake.plans import bridge, checks

QUERIES = checks.queries()
LAZY = [q for q in QUERIES if not q.startswith(("scan_", "land_", "append_", "replace_", "publish_", "backfill_"))
        and not q.endswith(("_stored", "_stored_month", "_from_store"))
        and q not in ("ingest_required_columns", "ingest_malformed")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str, table: str) -> set[str]:
    """Columns a plan reads of a table, over all its scans."""
    found = set()
    for line in text.splitlines():
        if f"/{table}.parquet" in line:
            schema = line[line.index("ReadSchema: struct<") + len("ReadSchema: struct<"):]
            found |= set(re.findall(r"(\w+):", schema))
    return found


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, conf, name):
    for threshold in ("10485760", "-1"):
        conf(spark__sql__autoBroadcastJoinThreshold=threshold)
        text = plan(QUERIES[name](spark, SMALL))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
            assert node not in text, (name, node)


@pytest.mark.parametrize("name, tables", [
    ("etl_price_bucket", {"lineitem"}),
    ("dq_report", {"lineitem"}),
    ("count_processed", {"lineitem"}),
    ("report_products", {"lineitem", "part"}),
    ("report_customers", {"lineitem", "orders"}),
    ("report_revenue_bucket", {"lineitem", "orders"}),
    ("fact_typed", {"lineitem", "orders"}),
])
def test_only_needed_tables_are_read(spark, name, tables):
    text = plan(QUERIES[name](spark, SMALL))
    assert set(re.findall(r"/(\w+)\.parquet", text)) == tables


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["report_revenue_bucket"](spark, SMALL))
    assert read_columns(text, "lineitem") == {"l_orderkey", "l_quantity", "l_extendedprice"}
    assert read_columns(text, "orders") == {"o_orderkey", "o_orderdate"}
    assert read_columns(plan(QUERIES["count_processed"](spark, SMALL)), "lineitem") == set()


def test_a_report_is_one_aggregate_over_one_scan(spark):
    text = plan(QUERIES["dq_report"](spark, SMALL))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_lines_are_summed_before_the_join(spark, conf):
    """The join on the order finds the lines partitioned by the aggregate."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(QUERIES["report_customers"](spark, SMALL))
    assert text.count("partial_sum(revenue_cents") == 2
    assert text.count("Exchange hashpartitioning") == 3  # lines, orders, customers


@pytest.mark.parametrize("join, hashed_up_to", [("SortMergeJoin", "0"), ("ShuffledHashJoin", "64m")])
def test_hot_keys_are_split_at_run_time(spark, conf, hot_dir, tmp_path, join, hashed_up_to):
    for name in ("lineitem", "orders", "customer", "nation", "part"):
        spread = spark.read.parquet(f"{hot_dir}/{name}.parquet").repartition(8)
        spread.write.parquet(f"{tmp_path}/{name}.parquet")
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=hashed_up_to,
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    columns = ["order_id", "order_date", "product_id", "quantity", "price"]
    joined = bridge.sales_raw(spark, str(tmp_path), columns)
    rows = joined.collect()
    assert f"{join}(skew=true)" in plan(joined)
    whole = duck(hot_dir).sql(f"WITH {checks.SALES} SELECT {', '.join(columns)} FROM sales_raw")
    assert rows_of(columns, rows) == rows_of(columns, whole.fetchall())

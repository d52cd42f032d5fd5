"""Publishing and reports. No database is started: the JDBC sink is checked up to
the call it makes."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import Decimal
from unittest.mock import MagicMock

import pytest
from conftest import SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas
from ledgerlake.errors import PublishMismatch
from ledgerlake.operators import fact, reports
from ledgerlake.plans import bridge, checks
from ledgerlake.sources import jdbc

ROW = ("ORD000000042", "PROD100001", "CUST100002", 3, 10.1, 30.299999999999997, "LOW",
       dt.date(2026, 1, 27), 2026, 1, "2026-01-27")


def projected(spark, **changed):
    types = [schemas.PROCESSED[n].dataType for n in schemas.FACT.names]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(schemas.FACT.names, types)])
    values = dict(zip(schemas.FACT.names, ROW)) | changed
    return spark.createDataFrame([tuple(values[n] for n in schemas.FACT.names)], schema)


def test_typed_fact(spark):
    typed = schemas.assert_schema(fact.typed(projected(spark)), schemas.FACT)
    assert tuple(typed.first()) == (
        42, 100001, 100002, 3, Decimal("10.10"), Decimal("30.30"), "LOW",
        dt.date(2026, 1, 27), 2026, 1, dt.date(2026, 1, 27),
    )


def test_typed_fact_stops_on_bad_ids(spark):
    for changed in ({"order_id": "ORDx"}, {"order_id": None}, {"product_id": "7"}, {"order_id": "ORD3000000000"}):
        with pytest.raises(PySparkException):
            fact.typed(projected(spark, **changed)).collect()
    assert fact.typed(projected(spark, customer_id=None)).first().customer_id is None
    wide = fact.typed(projected(spark, order_id="ORD3000000000"), T.LongType())
    assert schemas.assert_schema(wide, schemas.fact(T.LongType())).first().order_id == 3_000_000_000


def test_jdbc_target():
    assert jdbc.url("db.example", "sales") == (
        "jdbc:sqlserver://db.example:1433;database=sales;encrypt=true;"
        "trustServerCertificate=false;loginTimeout=30;"
    )
    target = jdbc.connection("jdbc:x", user="u", password="p")
    assert target["dbtable"] == "dbo.fact_sales" and target["user"] == "u"
    assert jdbc.connection("jdbc:x", dbtable="t", driver="d")["dbtable"] == "t"


def test_jdbc_write_replaces_rows_and_keeps_declared_types():
    df = MagicMock()
    jdbc.replace_table(df, jdbc.connection("jdbc:x", user="u", password="p"), connections=4)
    df.write.format.assert_called_once_with("jdbc")
    options = df.write.format().options.call_args.kwargs
    assert options["truncate"] == "true" and options["numPartitions"] == "4"
    assert options["url"] == "jdbc:x" and options["batchsize"] == "10000"
    writer = df.write.format().options()
    writer.mode.assert_called_once_with("overwrite")
    writer.mode().save.assert_called_once_with()


def test_jdbc_write_reaches_the_driver_lookup(spark):
    target = jdbc.connection("jdbc:none:x", driver="no.such.Driver")
    with pytest.raises(Exception, match="no.such.Driver"):
        jdbc.replace_table(fact.typed(projected(spark)), target)


def test_published_count_is_checked():
    spark = MagicMock()
    spark.read.format().options().load().first.return_value = (7,)
    target = jdbc.connection("jdbc:x", dbtable="t")
    jdbc.check_count(spark, target, 7)
    query = spark.read.format().options.call_args.kwargs["dbtable"]
    assert query == "(SELECT COUNT(*) AS published FROM t) counted"
    with pytest.raises(PublishMismatch, match="sent 6 rows, target holds 7"):
        jdbc.check_count(spark, target, 6)


@pytest.fixture(scope="module")
def rows(spark):
    return checks.processed(spark, SMALL).collect()


def brute_force(rows, *keys):
    out = defaultdict(lambda: [0, 0, Decimal(0)])
    for r in rows:
        group = out[tuple(r[k] for k in keys)]
        group[0] += 1
        group[1] += r.quantity
        group[2] += Decimal(str(r.total_amount)).quantize(Decimal("0.01"))
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("report, query, keys", [
    (reports.daily_sales, checks.report_daily_sales, ["order_date"]),
    (reports.monthly_sales, checks.report_monthly_sales, ["order_year", "order_month"]),
    (reports.revenue_by_bucket, checks.report_revenue_bucket, ["order_year", "order_month", "price_bucket"]),
    (reports.product_sales, checks.report_products, ["category", "product_id"]),
    (reports.category_sales, checks.report_categories, ["category"]),
    (reports.customer_sales, checks.report_customers, ["customer_id"]),
])
def test_reports(spark, rows, report, query, keys):
    """From the processed table and from the order tables, against adding up rows."""
    expected = brute_force(rows, *keys)
    for result in (report(reports.measures(checks.processed(spark, SMALL))), query(spark, SMALL)):
        found = {tuple(r[k] for k in keys): (r.sales, r.units, r.revenue) for r in result.collect()}
        assert found == expected


def test_cents_round_as_the_published_decimal(spark):
    amounts = [10.005, 1.005, 2.675, 0.125, 0.135, 30.299999999999997, -10.005, 1e9 + 0.005, 0.0, None]
    amounts += [n / 1000 for n in range(0, 100_000, 5)]
    df = spark.createDataFrame([(1, a) for a in amounts], "quantity int, total_amount double")
    both = reports.in_money(reports.measures(df).withColumn("exact", F.col("total_amount").cast("decimal(12,2)")))
    assert both.filter(~F.col("revenue").eqNullSafe(F.col("exact"))).isEmpty()


def test_average_and_top(spark, rows):
    measured = reports.measures(checks.processed(spark, SMALL))
    for r in reports.customer_sales(measured).collect():
        assert r.average_value == float(r.revenue) / r.sales
    per_product = brute_force(rows, "category", "product_id")
    best = sorted(((-v[2], k[1]) for k, v in per_product.items()))[:3]
    top = reports.top_products(reports.product_sales(measured), 3).collect()
    assert [(-r.revenue, r.product_id) for r in top] == best


def test_preview_is_the_smallest_rows(spark):
    typed = checks.fact_typed(spark, SMALL)
    first = fact.preview(typed).collect()
    assert len(first) == 5 and first == sorted(typed.collect())[:5]


def test_bridge_keeps_every_line(spark, hot_dir):
    lines = spark.read.parquet(f"{hot_dir}/lineitem.parquet").count()
    raw = bridge.sales_raw(spark, hot_dir)
    assert raw.count() == lines
    assert raw.filter(F.col("order_date").isNull()).count() > 0
    assert raw.filter(F.col("category").isNull()).count() > 0

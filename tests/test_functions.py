from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake.errors import BadRunDate
from ledgerlake.functions import draws, ids, params, sales


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_price_bucket_bounds(spark):
    prices = [(-1.0,), (499.99,), (500.0,), (1999.99,), (2000.0,), (None,), (math.nan,)]
    assert values(spark, prices, "price double", sales.price_bucket(F.col("price"))) == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH",
    ]


def test_year_month_is_unpadded_and_skips_nulls(spark):
    parts = [(2026, 1), (2026, 10), (None, None), (2026, None)]
    label = sales.year_month(F.col("y"), F.col("m"))
    assert values(spark, parts, "y int, m int", label) == ["2026-1", "2026-10", "", "2026"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unreadable_date_is_null(spark, conf, ansi):
    conf(spark__sql__ansi__enabled=ansi)
    texts = [("2026-01-27",), ("garbage",), ("",), (None,)]
    assert values(spark, texts, "d string", sales.parsed_date(F.col("d"))) == [
        dt.date(2026, 1, 27), None, None, None,
    ]


def test_order_id_pads_but_never_cuts(spark):
    numbers = [(42,), (123456789,), (12345678901,)]
    assert values(spark, numbers, "n bigint", ids.order_id(F.col("n"))) == [
        "ORD000000042", "ORD123456789", "ORD12345678901",
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_id_number(spark, conf, ansi):
    conf(spark__sql__ansi__enabled=ansi)
    number = ids.number_of(F.col("i"), fv.ORDER_PREFIX, T.IntegerType())
    required = ids.number_of(F.col("i"), fv.ORDER_PREFIX, T.IntegerType(), required=True)
    wide = ids.number_of(F.col("i"), fv.ORDER_PREFIX, T.LongType())
    assert values(spark, [("ORD000000042",), (None,)], "i string", number) == [42, None]
    assert values(spark, [("ORD12345678901",)], "i string", wide) == [12345678901]
    for bad in ("ORDx", "42", "PROD42", "", "ORD4 2", "ORD12345678901"):
        with pytest.raises(PySparkException, match="not a ORD id"):
            values(spark, [(bad,)], "i string", number)
    with pytest.raises(PySparkException, match="null"):
        values(spark, [(None,)], "i string", required)


def test_run_date():
    assert params.run_date("2026-01-27") == dt.date(2026, 1, 27)
    assert params.run_date(dt.date(2026, 1, 27)) == dt.date(2026, 1, 27)
    for bad in ("27-01-2026", "2026/01/27", "2026-02-30", "2026-01-27T00:00", "", "today"):
        with pytest.raises(BadRunDate):
            params.run_date(bad)


def test_paths():
    assert params.raw_path("s3a://lake/raw/", dt.date(2026, 1, 5)) == (
        "s3a://lake/raw/sales/2026/01/05/sales_raw.csv"
    )
    paths = params.raw_paths("z", dt.date(2026, 1, 30), dt.date(2026, 2, 1))
    assert [p[8:18] for p in paths] == ["2026/01/30", "2026/01/31", "2026/02/01"]


def test_draws_cover_their_bounds_evenly(spark):
    seed = draws.digest("day", F.col("id"))
    drawn = spark.range(60_000).select(
        draws.between(draws.draw(seed, "quantity"), fv.QUANTITY).alias("quantity"),
        draws.between(draws.draw(seed, "price"), fv.PRICE_CENTS).alias("cents"),
        draws.pick(draws.draw(seed, "payment_type"), fv.PAYMENT_TYPES).alias("payment"),
    )
    quantities = {r.quantity: r["count"] for r in drawn.groupBy("quantity").count().collect()}
    payments = {r.payment: r["count"] for r in drawn.groupBy("payment").count().collect()}
    assert set(quantities) == {1, 2, 3, 4, 5} and set(payments) == set(fv.PAYMENT_TYPES)
    for n in [*quantities.values(), *payments.values()]:
        assert abs(n - 12_000) < 500
    low, high, mean = drawn.agg(F.min("cents"), F.max("cents"), F.avg("cents")).first()
    assert 15_000 <= low < 20_000 and 7_990_000 < high <= 8_000_000
    assert abs(mean - 4_007_500) < 40_000

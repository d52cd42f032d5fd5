from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.operators import dimensions, generate, ordinals

DAY = dt.date(2026, 1, 27)


@pytest.fixture(scope="module")
def dims(spark):
    products = dimensions.products(dimensions.base_catalogue(spark))
    customers = dimensions.customers(dimensions.customer_ordinals(spark, 500))
    return dimensions.with_keys(products, customers)


def test_product_dimension(spark):
    products = dimensions.products(dimensions.base_catalogue(spark))
    schemas.assert_schema(products, schemas.PRODUCT)
    rows = sorted(tuple(r) for r in products.collect())
    assert len(rows) == 635
    assert [r[0] for r in rows] == [f"PROD{n}" for n in range(100_000, 100_635)]
    assert rows[0] == ("PROD100000", "Mobile Phone Variant 1", "Electronics")
    assert rows[-1] == ("PROD100634", "Cycling Gloves Variant 5", "Sports")
    assert Counter(r[2] for r in rows) == {
        "Electronics": 125, "Clothing": 110, "Home": 120, "Books": 90, "Beauty": 100, "Sports": 90,
    }


def test_customer_dimension(spark):
    customers = dimensions.customers(dimensions.customer_ordinals(spark))
    schemas.assert_schema(customers, schemas.CUSTOMER)
    n, distinct, low, high, names, cities = customers.agg(
        F.count("*"), F.count_distinct("customer_id"), F.min("customer_id"), F.max("customer_id"),
        F.count_distinct("customer_name"), F.count_distinct("city"),
    ).first()
    assert (n, distinct, low, high) == (50_000, 50_000, "CUST100000", "CUST149999")
    assert (names, cities) == (25 * 20, len(dimensions.CITIES))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    keys=st.sets(st.integers(-2**40, 2**40), min_size=1, max_size=60)
    | st.sets(st.integers(-40, 400), min_size=1, max_size=60),
    bits=st.tuples(st.integers(0, 6), st.integers(0, 4)),
)
def test_ordinals_number_each_group_in_key_order(spark, keys, bits):
    rows = [(k, "ab"[k % 3 == 0]) for k in keys]
    df = spark.createDataFrame(rows, "k bigint, g string")
    numbered = ordinals.with_ordinal(df, "k", by=["g"], range_bits=bits[0], block_bits=bits[1])
    expected = {
        (k, g, i) for group in "ab"
        for i, (k, g) in enumerate(sorted(r for r in rows if r[1] == group))
    }
    assert {tuple(r) for r in numbered.collect()} == expected
    whole = ordinals.with_ordinal(df, "k", range_bits=bits[0], block_bits=bits[1])
    assert sorted((r.k, r.ordinal) for r in whole.collect()) == [(k, i) for i, k in enumerate(sorted(keys))]


def windows(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]


def test_hashed_keys_are_numbered_in_small_windows_over_many_tasks(spark, conf):
    """64-bit hashes use all digits. No window is over everything, and none holds more rows
    than a block has members."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    numbered = ordinals.with_ordinal(df, "k")
    assert len(windows(numbered)) == 7 and "SinglePartition" not in numbered._jdf.queryExecution().toString()
    got = sorted((r.ordinal, r.k) for r in numbered.collect())
    keys = sorted(r.k for r in df.collect())
    assert got == list(enumerate(keys))
    for shift in range(10, 64, 10):
        members = Counter()
        for node in {k >> (shift - 10) for k in keys}:
            members[node >> 10] += 1
        assert max(members.values()) <= 1024


def test_a_dense_key_needs_few_levels(spark):
    df = spark.range(0, 3_000_000, 3).withColumnRenamed("id", "k")
    numbered = ordinals.with_ordinal(df, "k")
    assert len(windows(numbered)) == 3
    assert numbered.filter("ordinal <> k div 3").isEmpty()


def test_equal_keys_are_ordered_by_what_follows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (0, "c"), (None, "a")], "k bigint, name string")
    numbered = ordinals.with_ordinal(df, "k", range_bits=0, then=["name"])
    assert sorted((r.name, r.ordinal or 0) for r in numbered.filter("k is not null").collect()) == [("a", 1), ("b", 2), ("c", 0)]


def test_rows_without_a_key_are_no_hot_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("n"))
    numbered = ordinals.with_ordinal(df, "k")
    assert numbered.filter("k is null and ordinal is not null").isEmpty()
    assert numbered.filter("k is not null and ordinal = n div 2").count() == 2500
    assert numbered.count() == 5000


def test_categories_are_numbered_by_name(spark):
    names = ["b", "", "longer name 2", "longer name 10", "é", "a", "日本語の文章", "z"]
    sizes = dimensions.category_sizes(spark.createDataFrame([(n,) for n in names * 3] + [(None,)], "category string"))
    assert [(r.category, r.products) for r in sizes.orderBy("category_number").collect()] == [
        (n, 3) for n in sorted(names, key=str.encode)]


def test_rows_without_key_or_group_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (3, "a")], "k bigint, g string")
    numbered = ordinals.with_ordinal(df, "k", by=["g"]).collect()
    assert sorted(map(str, (tuple(r) for r in numbered))) == sorted(
        map(str, [(1, "a", 0), (2, None, None), (None, "a", None), (3, "a", 1)])
    )


def test_allocated_ids_continue_from_the_mark(spark):
    existing = spark.createDataFrame([(5,), (197_690,), (None,)], "n bigint")
    batch = spark.createDataFrame([(30,), (10,), (20,)], "k bigint")
    mark = ordinals.high_water(existing, "n", fv.LAST_ORDER_NUMBER)
    allocated = ordinals.allocate_order_ids(batch, "k", mark)
    assert sorted(map(tuple, allocated.collect())) == [
        (10, "ORD000197691"), (20, "ORD000197692"), (30, "ORD000197693"),
    ]
    empty = ordinals.high_water(existing.limit(0), "n", fv.LAST_ORDER_NUMBER)
    assert ordinals.allocate_order_ids(batch, "k", empty).agg(F.min("order_id")).first()[0] == "ORD000197682"


def expected_sale(number, products, customers):
    """The same draws, sale by sale."""
    seed = hashlib.sha256(f"{DAY}:{number}".encode()).hexdigest()
    category = sorted(products)[int(seed[0:8], 16) % len(products)]
    product = products[category][int(seed[8:22], 16) % len(products[category])]
    customer = customers[int(seed[22:36], 16) % len(customers)]
    return (
        f"ORD{number:09d}", DAY, customer.customer_id, customer.customer_name, product.product_id,
        product.product_name, category, int(seed[36:44], 16) % 5 + 1,
        (int(seed[44:56], 16) % 7_985_001 + 15_000) / 100, customer.city,
        fv.PAYMENT_TYPES[int(seed[56:64], 16) % 5],
    )


def test_generated_day_equals_drawing_sale_by_sale(spark, dims):
    batch = generate.sales_day(spark, DAY, *dims, rows=400)
    schemas.assert_schema(batch, schemas.RAW)
    products = {}
    for p in sorted(dims[0].collect(), key=lambda p: p.product_key):
        products.setdefault(p.category, []).append(p)
    customers = sorted(dims[1].collect(), key=lambda c: c.customer_key)
    first = fv.LAST_ORDER_NUMBER + 1
    expected = [expected_sale(n, products, customers) for n in range(first, first + 400)]
    assert sorted(map(tuple, batch.collect())) == expected


def test_generated_day_is_repeatable_and_sized(spark, dims):
    sizes = [generate.batch_size(DAY + dt.timedelta(n)) for n in range(300)]
    assert min(sizes) >= 5000 and max(sizes) <= 7000 and len(set(sizes)) > 200
    batch = generate.sales_day(spark, DAY, *dims)
    again = generate.sales_day(spark, DAY, *dims).repartition(7)
    assert batch.count() == generate.batch_size(DAY)
    assert batch.exceptAll(again).isEmpty() and again.exceptAll(batch).isEmpty()
    other = generate.sales_day(spark, DAY + dt.timedelta(1), *dims)
    assert batch.select("order_id", "price").intersect(other.select("order_id", "price")).count() < 50


def test_categories_weigh_the_same_whatever_their_size(spark):
    products = spark.createDataFrame(
        [("PROD100000", "only", "small")] + [(f"PROD{100001 + i}", "one of many", "large") for i in range(99)],
        schemas.PRODUCT,
    )
    customers = dimensions.customers(dimensions.customer_ordinals(spark, 10))
    batch = generate.sales_day(spark, DAY, *dimensions.with_keys(products, customers), rows=4000)
    share = batch.filter("category = 'small'").count() / 4000
    assert abs(share - 0.5) < 0.03

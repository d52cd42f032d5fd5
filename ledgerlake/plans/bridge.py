"""Raw sales as a view over normalised order tables.

Attributes are looked up with left joins: each lookup finds at most one row, so a
sale is never lost or repeated, and a table none of whose columns is asked for need
not be read at all.

At scale the order of the joins matters more than their kind. Order lines are by
far the largest table, so customers and nations are first attached to orders, and
lines are shuffled once for parts and once for orders, the wider side last. No join is hinted: Spark
broadcasts a side only when its size is under the session's threshold, and splits
partitions of hot keys when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.functions import ids, sales
from ledgerlake.operators import reports

ORDER_COLUMNS = {"order_date", "payment_type", "customer_id", "customer_name", "city"}
CUSTOMER_COLUMNS = {"customer_name", "city"}
PART_COLUMNS = {"product_name", "category"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_price() -> Column:
    """Whole cents, rounded down, so that every engine casts it to the same decimal."""
    cents = F.col("l_extendedprice") * 100 / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return F.floor(cents).cast("double") / 100


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sale takes from its order line alone."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"),
        unit_price().alias("price"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("payment_type"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city")
    )
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.col("c_name").alias("customer_name"), "c_nationkey")
        .join(nations, "c_nationkey", "left")
        .drop("c_nationkey")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    )


def sales_raw(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(schemas.RAW.names)
) -> DataFrame:
    """Sales in the raw shape. Keys of the order tables may be asked for by name too.

    The text ids are made from the keys after the joins, so that the shuffles carry
    numbers.
    """
    made = {
        "order_id": ids.order_id(F.col("l_orderkey")),
        "product_id": ids.product_id(F.col("l_partkey")),
        "customer_id": ids.customer_id(F.col("c_custkey")),
    }
    wanted = set(columns)
    sold = lines(spark, sf_dir)
    if wanted & PART_COLUMNS:
        sold = sold.join(products(spark, sf_dir), "l_partkey", "left")
    if wanted & ORDER_COLUMNS:
        headers = orders(spark, sf_dir)
        if wanted & CUSTOMER_COLUMNS:
            headers = headers.join(customers(spark, sf_dir), "c_custkey", "left")
        sold = sold.join(headers, "l_orderkey", "left")
    return sold.select(*(made[c].alias(c) if c in made else c for c in columns))


def with_defects(df: DataFrame) -> DataFrame:
    """Break values by a rule on `l_orderkey`, for checks that must find something."""
    def every(n: int) -> Column:
        return F.col("l_orderkey") % n == 0

    return df.withColumns({
        "order_id": F.when(~every(101), F.col("order_id")),
        "quantity": F.when(every(97), F.lit(0)).when(~every(89), F.col("quantity")),
        "price": F.when(every(103), -F.col("price")).when(~every(107), F.col("price")),
    })


def measured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the report measures and their table keys, before any join."""
    amount = sales.total_amount(F.col("quantity"), F.col("price"))
    return reports.measures(lines(spark, sf_dir).withColumn("total_amount", amount))


def measured_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures per order with its header.

    Lines are summed per order before the join, on the join's own key: an order
    with very many lines reaches the join as one row, and the join needs no
    shuffle of its own on this side.
    """
    per_order = reports.rollup(measured_lines(spark, sf_dir), ["l_orderkey"])
    return per_order.join(orders(spark, sf_dir), "l_orderkey", "left")


def measured_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures per customer, summed on the number; the id is written once per customer."""
    per_customer = reports.rollup(measured_orders(spark, sf_dir), ["c_custkey"])
    return per_customer.select(
        ids.customer_id(F.col("c_custkey")).alias("customer_id"), *reports.MEASURES
    )


def measured_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures per product with its category, summed before the join as above."""
    per_part = reports.rollup(measured_lines(spark, sf_dir), ["l_partkey"])
    return per_part.join(products(spark, sf_dir), "l_partkey", "left").select(
        "category", ids.product_id(F.col("l_partkey")).alias("product_id"), *reports.MEASURES
    )

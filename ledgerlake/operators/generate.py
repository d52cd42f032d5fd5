"""Daily sales batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.functions import draws, ids
from ledgerlake.operators import dimensions
from ledgerlake.operators.ordinals import with_ordinal


def sale_numbers(spark: SparkSession, rows: int, high_water: int) -> DataFrame:
    """Gap-free numbers after the high-water mark. `range` splits them over tasks
    by arithmetic, so nothing is shuffled to number the rows."""
    return spark.range(high_water + 1, high_water + 1 + rows).select(
        F.col("id").alias("order_number")
    )


def draw_sales(
    numbers: DataFrame, day: dt.date, products: DataFrame, customers: DataFrame,
    buyers: DataFrame | None = None,
) -> DataFrame:
    """One sale per order number.

    A product is drawn in two stages, first a category and then a product of it, so
    that a product's weight is 1 / (categories * products in its category). The
    dimensions carry a unique integer `product_key` and `customer_key`. `buyers` has as many
    rows as `customers`; give it where counting those would run their joins.
    """
    customer_count = (customers if buyers is None else buyers).agg(F.count(F.lit(1)).alias("customers")).scalar()
    sizes = dimensions.category_sizes(products)
    categories = products.agg(F.count_distinct("category").alias("categories")).scalar()
    seeded = numbers.select(
        "order_number", draws.digest(day.isoformat(), F.col("order_number")).alias("_seed"),
    )

    def drawn(name: str) -> Column:
        return draws.draw(F.col("_seed"), name)

    seeded = seeded.withColumn("category_number", drawn("category") % categories)
    chosen = seeded.join(sizes, "category_number").select(
        "order_number",
        "category",
        (drawn("product") % F.col("products")).alias("category_position"),
        (drawn("customer") % customer_count).alias("customer_ordinal"),
        draws.between(drawn("quantity"), fv.QUANTITY).cast("int").alias("quantity"),
        (draws.between(drawn("price"), fv.PRICE_CENTS) / 100).alias("price"),
        draws.pick(drawn("payment_type"), fv.PAYMENT_TYPES).alias("payment_type"),
    )
    return denormalize(chosen, products, customers).select(
        ids.order_id(F.col("order_number")).alias("order_id"),
        F.lit(day).cast("date").alias("order_date"),
        *schemas.RAW.names[2:],
    )


def denormalize(chosen: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Copy product and customer attributes onto each sale.

    Both lookups find exactly one row, so left joins keep every sale. No side is
    hinted: Spark broadcasts a dimension only when its size allows, and otherwise
    splits hot products or customers at run time.
    """
    by_position = dimensions.products_by_category(products, "product_key")
    by_ordinal = with_ordinal(customers, "customer_key", name="customer_ordinal")
    return chosen.join(by_position, ["category", "category_position"], "left").join(
        by_ordinal, "customer_ordinal", "left"
    )


def batch_size(day: dt.date) -> int:
    return draws.day_rows(day.isoformat(), fv.DAY_ROWS)


def sales_day(
    spark: SparkSession,
    day: dt.date,
    products: DataFrame,
    customers: DataFrame,
    high_water: int = fv.LAST_ORDER_NUMBER,
    rows: int | None = None,
) -> DataFrame:
    """A day's raw batch. Repeating it with the same mark gives the same rows."""
    numbers = sale_numbers(spark, batch_size(day) if rows is None else rows, high_water)
    return draw_sales(numbers, day, products, customers)

"""Reports on sales.

Every report is a rollup of the same additive measures, so a frame that is already
rolled up on a finer key can be rolled up further with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ["sales", "units", "revenue_cents"]
MONEY = "decimal(28,2)"


def measures(df: DataFrame) -> DataFrame:
    """Give each sale its measures.

    Money is rounded as the published decimal is and then summed in whole cents: the
    order in which rows are summed cannot change the result, and integers sum faster
    than decimals. A group may hold 92 quadrillion in all before the sum, under ANSI
    mode, stops the job.
    """
    return df.withColumns({
        "sales": F.lit(1).cast("bigint"),
        "units": F.col("quantity").cast("bigint"),
        "revenue_cents": F.rint(F.round("total_amount", 2) * 100).cast("bigint"),
    })


def rollup(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum the measures per key. Tasks pre-sum what they hold, so a key with very
    many rows costs one row per task in the shuffle."""
    return measured.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MEASURES))


def in_money(rolled_up: DataFrame) -> DataFrame:
    """The shape reports are given out in."""
    keys = [c for c in rolled_up.columns if c not in MEASURES]
    revenue = F.col("revenue_cents").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    return rolled_up.select(*keys, "sales", "units", revenue.cast(MONEY).alias("revenue"))


def daily_sales(measured: DataFrame) -> DataFrame:
    return in_money(rollup(measured, ["order_date"]))


def monthly_sales(measured: DataFrame) -> DataFrame:
    return in_money(rollup(measured, ["order_year", "order_month"]))


def revenue_by_bucket(measured: DataFrame) -> DataFrame:
    return in_money(rollup(measured, ["order_year", "order_month", "price_bucket"]))


def product_sales(measured: DataFrame) -> DataFrame:
    return in_money(rollup(measured, ["category", "product_id"]))


def category_sales(measured: DataFrame) -> DataFrame:
    return in_money(rollup(measured, ["category"]))


def top_products(per_product: DataFrame, k: int) -> DataFrame:
    return per_product.orderBy(F.col("revenue").desc(), "product_id").limit(k)


def customer_sales(measured: DataFrame) -> DataFrame:
    return with_average(in_money(rollup(measured, ["customer_id"])))


def with_average(rolled_up: DataFrame) -> DataFrame:
    average = F.col("revenue").cast("double") / F.col("sales")
    return rolled_up.withColumn("average_value", average)

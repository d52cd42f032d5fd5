"""Product and customer dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake.functions import draws, ids
from ledgerlake.operators.ordinals import with_ordinal

# Sample values; the generated names and cities stand for no real person.
GIVEN_NAMES = [
    "Aarav", "Aditi", "Ananya", "Arjun", "Deepa", "Divya", "Gaurav", "Ishaan", "Kavya", "Kiran",
    "Lakshmi", "Manoj", "Meera", "Neha", "Nikhil", "Pooja", "Priya", "Rahul", "Rohan", "Sanjay",
    "Shreya", "Sunita", "Tanvi", "Varun", "Vikram",
]
FAMILY_NAMES = [
    "Agarwal", "Banerjee", "Chopra", "Das", "Desai", "Gupta", "Iyer", "Jain", "Joshi", "Kapoor",
    "Khan", "Kulkarni", "Mehta", "Menon", "Nair", "Patel", "Rao", "Reddy", "Sharma", "Singh",
]
CITIES = [
    "Ahmedabad", "Bengaluru", "Bhopal", "Chandigarh", "Chennai", "Delhi", "Hyderabad", "Indore",
    "Jaipur", "Kochi", "Kolkata", "Lucknow", "Mumbai", "Nagpur", "Patna", "Pune", "Surat",
    "Vadodara",
]


def base_catalogue(spark: SparkSession) -> DataFrame:
    """One row per base product: category, base_name, base_ordinal in catalogue order."""
    rows, first = [], 0
    for category, names in fv.CATALOGUE.items():
        rows.append((category, names, first))
        first += len(names)
    listed = spark.createDataFrame(rows, "category string, names array<string>, first bigint")
    return listed.select(
        "category", "first", F.posexplode("names").alias("position", "base_name")
    ).select("category", "base_name", (F.col("first") + F.col("position")).alias("base_ordinal"))


def products(bases: DataFrame, variants: int = fv.VARIANTS_PER_PRODUCT) -> DataFrame:
    """Every base in `variants` variants. The id follows from the base's ordinal, so
    ids are dense without numbering the rows."""
    variant = F.col("variant")
    return bases.select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant")
    ).select(
        ids.product_id(F.col("base_ordinal") * variants + variant - 1).alias("product_id"),
        F.concat("base_name", F.lit(" Variant "), variant.cast("string")).alias("product_name"),
        "category",
    )


def customer_ordinals(spark: SparkSession, rows: int = fv.CUSTOMERS) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("customer_ordinal"))


def customers(ordinals: DataFrame) -> DataFrame:
    """A customer per ordinal; name and city are drawn from it."""
    seed = draws.digest("customer", F.col("customer_ordinal"))
    return ordinals.select(
        ids.customer_id(F.col("customer_ordinal")).alias("customer_id"),
        F.concat_ws(
            " ",
            draws.pick(draws.draw(seed, "product"), GIVEN_NAMES),
            draws.pick(draws.draw(seed, "customer"), FAMILY_NAMES),
        ).alias("customer_name"),
        draws.pick(draws.draw(seed, "price"), CITIES).alias("city"),
    )


def products_by_category(products_: DataFrame, key: str, **bits: int) -> DataFrame:
    """Group products by category: each gets its position in its category.

    A list per category would put the largest category into one row. Positions are
    the same grouping spread over rows, and a lookup joins on (category, position).
    `key` is a unique integer column giving the order. Further `bits` are those of
    `with_ordinal`.
    """
    return with_ordinal(products_, key, by=["category"], name="category_position", **bits)


def category_sizes(products_: DataFrame) -> DataFrame:
    """One row per category: category, products and category_number in name order.

    Categories are ordered by their first seven bytes, read as a number, and by name where
    those are equal, so that they too are numbered level by level. There is one row for each
    category, so levels are few and blocks large."""
    sizes = products_.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count(F.lit(1)).alias("products")
    )
    digits = F.rpad(F.hex(F.substring(F.encode("category", "UTF-8"), 1, 7)), 14, "0")
    keyed = sizes.withColumn("_first_bytes", F.conv(digits, 16, 10).cast("bigint"))
    return with_ordinal(
        keyed, "_first_bytes", name="category_number", range_bits=28, block_bits=28,
        then=["category"], span=(0, 2**56 - 1),
    ).drop("_first_bytes")


def with_keys(products_: DataFrame, customers_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored dimensions with the numbers in their ids, for drawing sales from them."""
    product_key = ids.number_of(F.col("product_id"), fv.PRODUCT_PREFIX, T.LongType(), required=True)
    customer_key = ids.number_of(F.col("customer_id"), fv.CUSTOMER_PREFIX, T.LongType(), required=True)
    return (
        products_.withColumn("product_key", product_key),
        customers_.withColumn("customer_key", customer_key),
    )

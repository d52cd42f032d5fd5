"""Reports from stored partial sums.

Measures add up, so each day is summed once, per report key, and stored under its day. A report
merges the days; when a day is replaced, only its sums are worked out again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas
from ledgerlake.operators import reports
from ledgerlake.plans.daily import Zones
from ledgerlake.sources import table
from ledgerlake.sources.files import loading

# What the sums of a day are kept by, and the reports that each store answers.
STORES = {
    "bucket": ["price_bucket"],
    "product": ["category", "product_id"],
    "customer": ["customer_id"],
}
REPORTS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "daily_sales": ("bucket", reports.daily_sales),
    "monthly_sales": ("bucket", reports.monthly_sales),
    "revenue_by_bucket": ("bucket", reports.revenue_by_bucket),
    "product_sales": ("product", reports.product_sales),
    "category_sales": ("product", reports.category_sales),
    "customer_sales": ("customer", reports.customer_sales),
}


def _schema(store: str) -> T.StructType:
    kinds = {f.name: f.dataType for f in schemas.PROCESSED}
    keys = [*STORES[store], "order_date"]
    return T.StructType(
        [T.StructField(c, kinds[c]) for c in keys]
        + [T.StructField(m, T.LongType()) for m in reports.MEASURES]
        + [T.StructField(c, T.IntegerType()) for c in table.DAY_KEYS]
    )


def in_days(days: Sequence[dt.date]) -> Column:
    """Rows of some days, by partition columns alone: other directories are not read."""
    number = F.col("order_year") * 10_000 + F.col("order_month") * 100 + F.col("order_day")
    return number.isin([d.year * 10_000 + d.month * 100 + d.day for d in days])


def store_sums(processed: DataFrame, store: str, path: str) -> None:
    """Replace the sums of every day that `processed` has rows of; other days stay. Tasks sum
    what they hold first, so a key with very many sales is one row for each task."""
    keys = [*STORES[store], "order_date", *table.DAY_KEYS]
    summed = reports.rollup(reports.measures(processed), keys).select(*_schema(store).names)
    (
        summed.hint("rebalance", *(F.col(k) for k in table.DAY_KEYS))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*table.DAY_KEYS).parquet(path)
    )


def refresh(spark: SparkSession, zones: Zones, days: Sequence[dt.date] | None = None) -> None:
    """Sum some days of the processed table again, or all of them."""
    stored = table.scan(spark, zones.processed, zones.fmt)
    if days is not None:
        stored = stored.filter(in_days(days))
    for store in STORES:
        store_sums(stored, store, f"{zones.rollups}/{store}")


def sums(spark: SparkSession, path: str, store: str) -> DataFrame:
    return loading(lambda: spark.read.schema(_schema(store)).parquet(path), path)


def report(spark: SparkSession, zones: Zones, name: str) -> DataFrame:
    """A report by name, merged from the stored sums; the sales themselves are not read."""
    store, merged = REPORTS[name]
    return merged(sums(spark, f"{zones.rollups}/{store}", store))

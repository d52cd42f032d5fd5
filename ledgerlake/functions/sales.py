"""Derived columns of a processed sale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv


def parsed_date(value: Column) -> Column:
    """A date, or null where the text is not one, also under ANSI mode."""
    return F.try_to_date(value)


def year_month(year: Column, month: Column) -> Column:
    """`2026-1`: unpadded, and empty when both parts are null. Sort by the parts."""
    return F.concat_ws("-", year, month)


def total_amount(quantity: Column, price: Column) -> Column:
    return quantity * price


def price_bucket(price: Column) -> Column:
    """A null or NaN price compares false with every bound, so it lands in the top bucket."""
    (bound, label), *rest = fv.BUCKET_BOUNDS
    bucket = F.when(price < bound, label)
    for bound, label in rest:
        bucket = bucket.when(price < bound, label)
    return bucket.otherwise(fv.TOP_BUCKET)

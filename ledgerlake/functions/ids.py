"""Business ids: a prefix and a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv


def order_id(number: Column) -> Column:
    """`ORD` and at least nine digits; lpad alone would cut longer numbers."""
    digits = number.cast("string")
    width = F.greatest(F.length(digits), F.lit(fv.ORDER_DIGITS))
    return F.concat(F.lit(fv.ORDER_PREFIX), F.lpad(digits, width, "0"))


def product_id(ordinal: Column) -> Column:
    return F.concat(F.lit(fv.PRODUCT_PREFIX), (ordinal + fv.FIRST_PRODUCT_NUMBER).cast("string"))


def customer_id(ordinal: Column) -> Column:
    return F.concat(F.lit(fv.CUSTOMER_PREFIX), (ordinal + fv.FIRST_CUSTOMER_NUMBER).cast("string"))


def number_of(
    identifier: Column, prefix: str, to: T.DataType, required: bool = False
) -> Column:
    """The number behind the prefix. An id of another shape, or a number too large
    for the type, stops the job rather than turning null. A null id stays null
    unless the column is required."""
    digits = F.substring(identifier, len(prefix) + 1, 2**31 - 1)
    number = F.when(identifier.rlike(rf"^{prefix}[0-9]+\z"), digits.try_cast(to))
    bad = F.raise_error(
        F.concat(F.lit(f"not a {prefix} id of type {to.simpleString()}: "),
                 F.coalesce(identifier, F.lit("null")))
    ).cast(to)
    checked = F.coalesce(number, bad)
    return checked if required else F.when(identifier.isNotNull(), checked)

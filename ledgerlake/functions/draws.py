"""Repeatable draws.

`rand(seed)` depends on how rows are partitioned, so a retried task would draw
other values. These draws are slices of one digest of the row's own key: the same
row gets the same values on any cluster, and one hash serves every column.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# First hex digit (from 1) and number of digits each draw takes of the digest.
# 14 digits are 56 bits, which fit a bigint and keep modulo bias negligible.
SLICES = {
    "category": (1, 8),
    "product": (9, 14),
    "customer": (23, 14),
    "quantity": (37, 8),
    "price": (45, 12),
    "payment_type": (57, 8),
}


def digest(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def draw(digest_: Column, name: str) -> Column:
    """A non-negative bigint, uniform over the slice's range."""
    start, length = SLICES[name]
    return F.conv(F.substring(digest_, start, length), 16, 10).cast("bigint")


def between(value: Column, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return value % (high - low + 1) + low


def pick(value: Column, options: list[str]) -> Column:
    return F.element_at(
        F.array(*map(F.lit, options)), (value % len(options) + 1).cast("int")
    )


def day_rows(salt: str, bounds: tuple[int, int]) -> int:
    """Size of a day's batch, drawn the same way, needed before there is any row."""
    low, high = bounds
    return low + int(hashlib.sha256(salt.encode()).hexdigest()[:12], 16) % (high - low + 1)

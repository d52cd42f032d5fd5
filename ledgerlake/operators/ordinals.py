"""Gap-free numbering of rows without pulling them through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ledgerlake.functions import ids

# Keys are cut into ranges of 2**RANGE_BITS, ranges into blocks of 2**BLOCK_BITS, those into
# blocks of as many, and so on. With a unique key no window holds more rows than one of these.
RANGE_BITS = 10
BLOCK_BITS = 10
LEAST_BITS = 4  # smaller blocks would only make more levels


def with_ordinal(
    df: DataFrame, key: str, by: Sequence[str] = (), name: str = "ordinal",
    range_bits: int = RANGE_BITS, block_bits: int = BLOCK_BITS, then: Sequence[str] = (),
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Add 0, 1, 2, ... in order of `key`, a unique integer column, within each `by` group.

    A window over a whole group would send the group to one task. Instead the key is read as
    digits: a row's number is the sum, over the digits, of the rows that share the digits
    before and have a smaller one here. Rows are numbered inside their range, and ranges,
    blocks and blocks of blocks are counted from one scan and added up level by level, each
    level in windows of one block. The number of levels follows the key's least and largest
    value, which one job finds first unless `span` gives them. The rows are shuffled once; the join that adds the
    start of their range finds them partitioned and sorted already.

    A key that is not unique needs `then`, columns that order rows of equal key; those are
    numbered in one window. A row whose `key` or `by` is null is kept, without a number; rows
    without a key are spread over the ranges, behind the rows that belong there.
    """
    by = list(by)
    low, high = span or df.agg(F.min(key).cast("bigint"), F.max(key).cast("bigint")).first()
    if low is None:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    integer = F.col(key).cast("bigint")
    ranged = df.withColumn("_range", F.coalesce(F.shiftright(integer, range_bits), F.xxhash64(*map(_quoted, df.columns))))
    order = [F.col(key).asc_nulls_last(), *then]
    within = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)) - 1
    keyed = ranged
    for column in (key, *by):
        keyed = keyed.filter(F.col(column).isNotNull())
    counts = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = _starts(counts, by, max(block_bits, LEAST_BITS), low >> range_bits, high >> range_bits)
    number = F.when(F.col(key).isNotNull(), F.col("_start") + F.col("_within"))
    return (
        ranged.withColumn("_within", within)
        .join(starts, [*by, "_range"], "left")
        .select(*map(_quoted, df.columns), number.alias(name))
    )


def _quoted(column: str) -> Column:
    return F.col(f"`{column}`")


def _starts(counts: DataFrame, by: list[str], bits: int, low: int, high: int) -> DataFrame:
    """Rows before each range. A block starts where the blocks before it in its own block end;
    the last level has one block, whose least member is `low`."""
    if high - low < 2**bits:
        block = F.shiftright(F.col("_range") - low, bits)  # 0: one block
        running = _sum_before("_rows", W.partitionBy(*by, "_block").orderBy("_range"))
        return counts.withColumn("_block", block).select(*by, "_range", running.alias("_start"))
    ranges = counts.withColumn("_block", F.shiftright("_range", bits))
    inside = ranges.withColumn("_before", _sum_before("_rows", W.partitionBy(*by, "_block").orderBy("_range")))
    blocks = ranges.groupBy(*by, F.col("_block").alias("_range")).agg(F.sum("_rows").alias("_rows"))
    above = _starts(blocks, by, bits, low >> bits, high >> bits).withColumnRenamed("_range", "_block")
    return inside.join(above, [*by, "_block"]).select(*by, "_range", (F.col("_start") + F.col("_before")).alias("_start"))


def _sum_before(column: str, window: WindowSpec) -> Column:
    running = F.sum(column).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
    return running - F.col(column)


def high_water(existing: DataFrame, number: str, start: int) -> Column:
    """The largest order number in use, as a scalar subquery; `start` in an empty table."""
    return existing.agg(F.coalesce(F.max(number), F.lit(start)).cast("bigint").alias("mark")).scalar()


def allocate_order_ids(df: DataFrame, key: str, mark: Column | int) -> DataFrame:
    """Continue the order-id series from `mark` over existing rows, in order of `key`."""
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    numbered = with_ordinal(df, key, name="_ordinal")
    return numbered.withColumn(
        "order_id", ids.order_id(mark + 1 + F.col("_ordinal"))
    ).drop("_ordinal")

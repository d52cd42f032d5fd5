"""The daily run: five steps, each reading what the one before it stored.

The steps are plain functions, and any scheduler may call them. All take the run
date as a date, and every step of a run gets the same one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.errors import EmptyPublish, MissingInput
from ledgerlake.functions import params
from ledgerlake.operators import dimensions, fact, generate, ingest, quality
from ledgerlake.operators.enrich import enrich
from ledgerlake.sources import files, folders, table

Sink = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Zones:
    """Where a lake keeps its data; any paths Spark can reach."""

    dimensions: str
    order_numbers: str
    source: str
    raw: str
    processed: str
    quarantine: str
    malformed: str
    rollups: str
    fmt: str = "parquet"

    @classmethod
    def under(cls, root: str, fmt: str = "parquet") -> Zones:
        root = root.rstrip("/")
        return cls(
            dimensions=f"{root}/dimensions", order_numbers=f"{root}/order_numbers",
            source=f"{root}/source", raw=f"{root}/raw",
            processed=f"{root}/processed/sales", quarantine=f"{root}/quarantine/sales",
            malformed=f"{root}/quarantine/records", rollups=f"{root}/rollups", fmt=fmt,
        )


@dataclass(frozen=True)
class DaySummary:
    run_date: dt.date
    rows_landed: int
    rows_quarantined: int
    rows_published: int


def build_dimensions(spark: SparkSession, zones: Zones) -> None:
    """Products and customers; needed once per lake."""
    products = dimensions.products(dimensions.base_catalogue(spark))
    customers = dimensions.customers(dimensions.customer_ordinals(spark))
    files.write_json(products, f"{zones.dimensions}/products")
    files.write_json(customers, f"{zones.dimensions}/customers")


def reserve_order_numbers(spark: SparkSession, zones: Zones, day: dt.date, rows: int) -> int:
    """Give a day its order numbers; returns the mark they follow.

    A day that is repeated at the same size gets the numbers it had. Otherwise they
    start after the highest number ever given out, also when days are run out of
    order. A reservation is one small record that is never replaced, so a failed run
    gives no number twice; the stored sales are not read.
    Days are reserved one at a time, as runs are.
    """
    mark = fv.LAST_ORDER_NUMBER
    try:
        taken = files.read_json(spark, zones.order_numbers, schemas.ORDER_RANGE)
    except MissingInput:
        taken = None
    if taken is not None:
        size = F.col("last_number") - F.col("first_number") + 1
        own = F.when((F.col("run_date") == F.lit(day)) & (size == rows), F.col("first_number"))
        highest = F.coalesce(F.max("last_number"), F.lit(mark))
        first, highest = taken.agg(F.max(own), highest).first()
        if first is not None:
            return first - 1
        mark = highest
    reserved = spark.range(1).select(
        F.lit(mark + 1).alias("first_number"), F.lit(mark + rows).alias("last_number")
    )
    # Records are only ever added: one that is replaced would be gone if the write failed.
    reserved.write.mode("append").json(f"{zones.order_numbers}/run_date={day}")
    return mark


def generate_day(
    spark: SparkSession, day: dt.date, zones: Zones, rows: int | None = None
) -> str:
    products, customers = dimensions.with_keys(
        files.read_json(spark, f"{zones.dimensions}/products", schemas.PRODUCT),
        files.read_json(spark, f"{zones.dimensions}/customers", schemas.CUSTOMER),
    )
    rows = generate.batch_size(day) if rows is None else rows
    mark = reserve_order_numbers(spark, zones, day, rows)
    batch = generate.sales_day(spark, day, products, customers, mark, rows)
    return files.land_raw(batch, zones.source, day)


def ingest_day(
    spark: SparkSession, day: dt.date, zones: Zones,
    ingested_on: dt.date | None = None, strict: bool = False,
    malformed: str = "fail", line_breaks: bool = False,
) -> str:
    """Check and stamp a day's batch. With `malformed="keep"` records that do not fit the
    contract's types are put aside, as text, under the quarantine zone and the others go on;
    a strict run takes none."""
    if strict and malformed == "keep":
        raise ValueError("a strict run keeps no malformed records")
    path = params.raw_path(zones.source, day)
    raw = files.read_csv(spark, path, schemas.RAW_FILE, malformed=malformed, line_breaks=line_breaks)
    if malformed == "keep":
        raw, _ = files.quarantine_malformed(raw, f"{zones.malformed}/{day}")
    stamped = ingest.stamp(ingest.validate(raw, strict), ingested_on)
    return files.land_raw(stamped, zones.raw, day, line_breaks)


def transform_day(
    spark: SparkSession, day: dt.date, zones: Zones, loaded_at: Column | None = None,
    line_breaks: bool = False,
) -> table.DayWrite:
    landed = files.read_csv(spark, params.raw_path(zones.raw, day), schemas.LANDED, line_breaks=line_breaks)
    processed = enrich(landed.select(*schemas.LANDED.names), day, loaded_at)
    schemas.assert_schema(processed, schemas.PROCESSED)
    return table.replace_day(processed, zones.processed, day, zones.quarantine, zones.fmt)


def transform_days(
    spark: SparkSession, first: dt.date, last: dt.date, zones: Zones, loaded_at: Column | None = None,
    line_breaks: bool = False,
) -> dict[dt.date, table.DayWrite]:
    """A backfill: the landed batches from `first` to `last` in one read and one write.

    The day of a batch is taken from its path. A day without a batch, or whose batch has no row
    of its date, keeps what is stored, so an earlier backfill can be repeated over any range.
    Raises if no day has a batch."""
    paths = {day: params.raw_path(zones.raw, day) for day in params.days(first, last)}
    paths = {day: path for day, path in paths.items() if folders.exists(spark, path)}
    if not paths:
        raise MissingInput(f"no input between {first} and {last} in {zones.raw}")
    landed = files.read_csv(spark, list(paths.values()), schemas.LANDED, line_breaks=line_breaks)
    day = params.day_of_path(F.col("_metadata.file_path"))
    batches = landed.select(*schemas.LANDED.names, day.alias(table.BATCH_DAY))
    processed = enrich(batches, F.col(table.BATCH_DAY), loaded_at)
    schemas.assert_schema(processed.drop(table.BATCH_DAY), schemas.PROCESSED)
    return table.replace_days(processed, zones.processed, list(paths), zones.quarantine, zones.fmt)


def check_day(
    spark: SparkSession, day: dt.date, zones: Zones, scope: str = "day", strict: bool = False
) -> DataFrame:
    """The quality report of a stored day; raises when a rule fails or a column is not stored."""
    table.check_stored(spark, zones.processed, day, scope, zones.fmt)
    stored = table.scan(spark, zones.processed, zones.fmt)
    report = quality.quality_report(quality.in_scope(stored, day, scope), strict)
    quality.gate(report)
    return report


def publish(
    spark: SparkSession, zones: Zones, sink: Sink,
    id_type: T.DataType = T.IntegerType(), persist: bool = False, since: dt.date | None = None,
) -> int:
    """Replace the published table with the whole processed table; returns its rows.
    With `since` the sink gets only rows of that day or later, and must merge them.

    Rows are counted before anything is sent, from file footers where all are sent. `persist` keeps the
    11 columns for a sink that reads them more than once; leave it off for a
    history larger than the executors' memory and disks.
    """
    stored = table.scan(spark, zones.processed, zones.fmt)
    if since is not None:
        stored = table.since(stored, since)
    rows = fact.count(stored).first()[0]
    if not rows:
        raise EmptyPublish(fv.EMPTY_PUBLISH_MESSAGE)
    published = fact.typed(fact.project(stored), id_type)
    if persist:
        published.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sink(published)
    finally:
        if persist:
            published.unpersist()
    return rows


def run_day(
    spark: SparkSession, run_date: str | dt.date, zones: Zones, sink: Sink,
    rows: int | None = None, ingested_on: dt.date | None = None, scope: str = "day",
    strict: bool = False, id_type: T.DataType = T.IntegerType(), since: dt.date | None = None,
    malformed: str = "fail", line_breaks: bool = False,
) -> DaySummary:
    """All five steps of a day. Any failed gate raises and leaves the rest undone. The
    options are those of the single steps."""
    day = params.run_date(run_date)
    generate_day(spark, day, zones, rows)
    ingest_day(spark, day, zones, ingested_on, strict, malformed, line_breaks)
    written = transform_day(spark, day, zones, line_breaks=line_breaks)
    check_day(spark, day, zones, scope, strict)
    published = publish(spark, zones, sink, id_type, since=since)
    return DaySummary(day, written.rows_seen, written.rows_off_day, published)


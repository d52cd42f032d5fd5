"""The processed table."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.errors import EmptyBatch, SchemaMismatch
from ledgerlake.sources import folders
from ledgerlake.sources.files import loading, observed

MONTH_KEYS = ["order_year", "order_month"]
DAY_KEYS = ["order_year", "order_month", "order_day"]


def _check_layout(spark: SparkSession, path: str, keys: list[str], fmt: str) -> None:
    """Raise if the table is there and partitioned by other keys: no reader could open it
    once both layouts are mixed."""
    found = keys if fmt == "delta" else folders.partition_keys(spark, path)
    if found and found != keys:
        raise SchemaMismatch(f"{path} is partitioned by {found}, not by {keys}")


def append(df: DataFrame, path: str, fmt: str = "parquet", keys: list[str] = MONTH_KEYS) -> None:
    """Add rows. Appending a batch twice stores it twice; see `replace_day`.

    A partition's rows are brought together so that it gets few files. A rebalance,
    unlike a repartition, lets Spark split a large day over many tasks and put small
    ones together, by the sizes it sees at run time."""
    _check_layout(df.sparkSession, path, keys, fmt)
    df.hint("rebalance", *(F.col(k) for k in keys)).write.format(fmt).mode("append").partitionBy(*keys).save(path)


@dataclass(frozen=True)
class DayWrite:
    rows_seen: int
    rows_off_day: int


# The day whose batch a row came in; not stored.
BATCH_DAY = "_batch_day"


def replace_day(
    df: DataFrame, path: str, day: dt.date, quarantine: str, fmt: str = "parquet"
) -> DayWrite:
    """Replace one day of a table partitioned by day, so that a run can be repeated.

    Only directories that receive rows are replaced. A row of another day would
    wipe that day, so rows whose date is not `day`, or is unreadable, are kept out
    and go to the day's directory under `quarantine`, in place of an earlier run's. A
    batch with nothing for the day leaves the stored day as it was and raises.
    """
    written = replace_days(df.withColumn(BATCH_DAY, F.lit(day)), path, [day], quarantine, fmt)[day]
    if written.rows_seen == written.rows_off_day:
        raise EmptyBatch(f"no rows dated {day} in the batch")
    return written


def replace_days(
    df: DataFrame, path: str, days: Sequence[dt.date], quarantine: str, fmt: str = "parquet"
) -> dict[dt.date, DayWrite]:
    """`replace_day` for the batches of many days, in one read and one write.

    BATCH_DAY names the batch of each row and is one of `days`. The rows of a batch that bear
    its date replace that day, and a day without any stays as it was. All other rows go to the
    batch's directory under `quarantine`.

    The jobs that write also count. Rows are counted behind the last shuffle, where Spark takes
    a task's count from the one attempt that succeeded. Only whether a batch has strays is seen
    before the shuffle, where a repeated task may count twice; if it has, they are written, and
    counted, by a job of their own.
    """
    spark = df.sparkSession
    _check_layout(spark, path, DAY_KEYS, fmt)
    on_day = F.coalesce(F.col("order_date") == F.col(BATCH_DAY), F.lit(False))
    days = sorted(set(days))
    looked, stored = Observation(), Observation()
    rows = df.observe(looked, *(F.count_if(~on_day & _of(day)).alias(day.isoformat()) for day in days)).filter(on_day)
    # One day goes to one directory, and needs no keys to shuffle by. The rows of several are
    # brought together by day, so that a day gets few files.
    rows = rows.hint("rebalance") if len(days) == 1 else rows.hint("rebalance", *(F.col(k) for k in DAY_KEYS))
    (
        rows.observe(stored, *(F.count_if(_of(day)).alias(day.isoformat()) for day in days)).drop(BATCH_DAY)
        .write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY_KEYS).save(path)
    )
    # Where nothing is stored, planning drops the write and the counts with it; then all is looked at.
    seen, counts = observed(looked), observed(stored)
    written = {}
    for day in days:
        strays = 0
        if seen.get(day.isoformat(), 1):
            strays = _quarantined(df.filter(~on_day & _of(day)).drop(BATCH_DAY), f"{quarantine}/{day.isoformat()}")
        else:
            folders.remove(spark, f"{quarantine}/{day.isoformat()}")
        written[day] = DayWrite(counts.get(day.isoformat(), 0) + strays, strays)
    return written


def _of(day: dt.date) -> Column:
    return F.col(BATCH_DAY) == F.lit(day)


def _quarantined(df: DataFrame, path: str) -> int:
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = observed(counted).get("rows", 0)
    if not rows:
        folders.remove(df.sparkSession, path)
    return rows


def scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The whole table, read in the format it was written in."""
    reader = spark.read.format(fmt)
    if fmt != "delta":  # a delta table brings its own schema
        reader = reader.schema(schemas.PROCESSED)
    found = loading(lambda: reader.load(path), path).select(*schemas.PROCESSED.names)
    return schemas.assert_schema(found, schemas.PROCESSED)


def check_stored(spark: SparkSession, path: str, day: dt.date, scope: str = "day", fmt: str = "parquet") -> None:
    """Raise if files of the day (or of a day of its month) lack a column or declare it of
    another type. A reader that is given the schema fills such a column with nulls, so the
    files are asked themselves. All files of one write job have one layout and carry the job's
    id in their name, so one file of each job speaks for it; the first odd one is named."""
    if fmt == "delta":  # the table itself holds and enforces its schema
        return
    wanted = schemas.T.StructType([f for f in schemas.PROCESSED.fields if f.name not in DAY_KEYS])
    days = range(1, 32) if scope == "month" else [day.day]
    for number in days:
        at = f"{path}/order_year={day.year}/order_month={day.month}/order_day={number}"
        for job, file in sorted(_file_of_each_job(folders.files(spark, at)).items()):
            found = loading(lambda file=file: spark.read.format(fmt).load(file), file)
            names = [n for n in wanted.names if n in found.columns]
            try:
                schemas.assert_schema(found.select(*names), wanted)
            except SchemaMismatch as e:
                raise SchemaMismatch(f"{file}, of write job {job}: {e}") from e


def _file_of_each_job(paths: Sequence[str]) -> dict[str, str]:
    """A file for each job; one whose name does not tell is taken as a job of its own."""
    found: dict[str, str] = {}
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if name.startswith(("_", ".")):
            continue
        told = re.fullmatch(r"part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[.-].*", name)
        found.setdefault(told.group(1) if told else name, path)
    return found


def since(df: DataFrame, first: dt.date) -> DataFrame:
    """Rows dated `first` or later. Year and month are partition columns, so earlier
    months are neither listed nor read."""
    month = F.col("order_year") * 12 + F.col("order_month")
    return df.filter((month >= first.year * 12 + first.month) & (F.col("order_date") >= F.lit(first)))

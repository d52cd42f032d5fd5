"""Run date and dated paths."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.errors import BadRunDate
from ledgerlake.fixed_values import RAW_FILE


def run_date(value: str | dt.date) -> dt.date:
    """One ISO day, checked before any Spark work starts."""
    if isinstance(value, dt.datetime):
        raise BadRunDate(f"run date must be a plain date, got {value!r}")
    if isinstance(value, dt.date):
        return value
    if not re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", value):
        raise BadRunDate(f"run date must be YYYY-MM-DD, got {value!r}")
    try:
        return dt.date(*map(int, value.split("-")))
    except ValueError as e:
        raise BadRunDate(f"run date must be YYYY-MM-DD, got {value!r}") from e


def raw_path(zone: str, day: dt.date) -> str:
    """Where a day's raw batch lives: `zone/sales/YYYY/MM/DD/sales_raw.csv`."""
    return f"{zone.rstrip('/')}/sales/{day:%Y/%m/%d}/{RAW_FILE}"


def day_of_path(path: Column) -> Column:
    """The day in the path of a raw file."""
    return F.to_date(F.regexp_extract(path, r"/sales/(\d{4}/\d{2}/\d{2})/[^/]+/[^/]*$", 1), "yyyy/MM/dd")


def days(first: dt.date, last: dt.date) -> Iterator[dt.date]:
    for n in range((last - first).days + 1):
        yield first + dt.timedelta(days=n)


def raw_paths(zone: str, first: dt.date, last: dt.date) -> list[str]:
    """A backfill is one read over many days' paths."""
    return [raw_path(zone, day) for day in days(first, last)]

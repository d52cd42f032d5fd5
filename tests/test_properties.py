"""Random rows against rules written out in plain Python."""

from __future__ import annotations

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.errors import DataQualityError, ValidationError
from ledgerlake.operators import ingest, quality
from ledgerlake.operators.enrich import enrich

FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
DAY = dt.date(2026, 1, 27)

ROWS = st.lists(st.tuples(
    st.sampled_from([None, "ORD000000001", "ORD000000002"]),
    st.sampled_from([None, "2026-01-27", "2026-10-05", "garbage", "2026-02-30"]),
    st.sampled_from([None, -1, 0, 1, 5]),
    st.sampled_from([None, -3.5, 0.0, 499.99, 500.0, 1999.99, 2000.0, math.nan]),
), max_size=8)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "order_id string, order_date string, quantity int, price double")
    others = {c: F.lit("x") for c in schemas.RAW_FILE.names if c not in df.columns}
    landed = df.withColumns(others).select(*schemas.RAW_FILE.names)
    return ingest.stamp(landed, DAY)


def bad(value):
    return value is not None and value <= 0


def times(quantity, price):
    return None if quantity is None or price is None else quantity * price


@FEW
@given(rows=ROWS)
def test_ingest_stops_on_the_first_broken_rule(spark, rows):
    expected = (
        "non_empty" if not rows
        else "order_id_not_null" if any(r[0] is None for r in rows)
        else "quantity_positive" if any(bad(r[2]) for r in rows)
        else "price_positive" if any(bad(r[3]) for r in rows)
        else None
    )
    try:
        ingest.validate(frame(spark, rows))
        found = None
    except ValidationError as e:
        found = e.rule
    assert found == expected


@FEW
@given(rows=ROWS)
def test_quality_counts_every_broken_rule(spark, rows):
    expected = [
        ("records_present", int(not rows)),
        ("order_id_not_null", sum(r[0] is None for r in rows)),
        ("quantity_positive", sum(bad(r[2]) for r in rows)),
        ("price_positive", sum(bad(r[3]) for r in rows)),
        ("total_amount_positive", sum(bad(times(r[2], r[3])) for r in rows)),
    ]
    try:
        quality.gate(quality.quality_report(enrich(frame(spark, rows), DAY)))
        found = []
    except DataQualityError as e:
        found = [(rule, n) for rule, _, n in e.failures]
    assert found == [(rule, n) for rule, n in expected if n]


def day_of(text):
    try:
        return text and dt.date.fromisoformat(text)
    except ValueError:
        return None


@FEW
@given(rows=ROWS)
def test_enrichment_keeps_every_row_and_derives_each_column(spark, rows):
    def derived(r):
        day, price = day_of(r[1]), r[3]
        bucket = "HIGH"
        if price is not None and not math.isnan(price):
            bucket = "LOW" if price < 500 else "MEDIUM" if price < 2000 else "HIGH"
        parts = (day.year, day.month, day.day) if day else (None, None, None)
        label = f"{day.year}-{day.month}" if day else ""
        return (r[0], day, *parts, label, times(r[2], price), bucket, "2026-01-27")

    enriched = enrich(frame(spark, rows), DAY, F.lit("2026-01-28 01:02:03").cast("timestamp"))
    schemas.assert_schema(enriched, schemas.PROCESSED)
    found = enriched.select(
        "order_id", "order_date", "order_year", "order_month", "order_day", "order_year_month",
        "total_amount", "price_bucket", "processing_date",
    ).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(derived, rows)))

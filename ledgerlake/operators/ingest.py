"""Checks and stamps between a raw file and the raw zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv
from ledgerlake.errors import MissingColumns, ValidationError
from ledgerlake.operators import rules
from ledgerlake.operators.rules import Rule


def missing_columns(columns: list[str]) -> list[str]:
    """Required columns absent from a file's real header; extra ones are fine."""
    return [c for c in fv.REQUIRED_COLUMNS if c not in columns]


def ingest_rules(strict: bool = False) -> list[Rule]:
    message = fv.INGEST_MESSAGES
    listed = [
        Rule("non_empty", message["non_empty"], rules.no_rows()),
        Rule("order_id_not_null", message["order_id_not_null"], rules.nulls("order_id")),
        Rule("quantity_positive", message["quantity_positive"], rules.not_positive("quantity")),
        Rule("price_positive", message["price_positive"], rules.not_positive("price")),
    ]
    return listed + (rules.not_null_rules("quantity", "price") if strict else [])


def validation_report(df: DataFrame, strict: bool = False) -> DataFrame:
    return rules.report(df, ingest_rules(strict))


def validate(df: DataFrame, strict: bool = False) -> DataFrame:
    """Gate: raise on the first failing rule (an empty batch before missing columns)."""
    missing = missing_columns(df.columns)
    if missing:
        if df.isEmpty():
            raise ValidationError("non_empty", fv.INGEST_MESSAGES["non_empty"], 1)
        raise MissingColumns(fv.INGEST_MESSAGES["required_columns"], missing)
    failed = rules.first_failure(validation_report(df, strict)).first()
    if failed is not None:
        raise ValidationError(failed.rule, failed.message, failed.violations)
    return df


def stamp(df: DataFrame, ingested_on: dt.date | None = None, source: str = fv.SOURCE_SYSTEM) -> DataFrame:
    """Add ingestion metadata; the clock is read only when no date is given."""
    day = F.current_date() if ingested_on is None else F.lit(ingested_on).cast("date")
    return df.withColumns({"ingestion_date": day, "source_system": F.lit(source)})

"""Data-quality rules over the processed table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv
from ledgerlake.errors import DataQualityError
from ledgerlake.operators import rules
from ledgerlake.operators.rules import Rule


def in_scope(df: DataFrame, run_date: dt.date, scope: str = "day") -> DataFrame:
    """The rows a run is judged on. Both scopes filter on partition columns, so only
    the directories of that day or month are listed and read."""
    keep = (F.col("order_year") == run_date.year) & (F.col("order_month") == run_date.month)
    if scope == "day":
        keep &= F.col("order_date") == F.lit(run_date)
        if "order_day" in df.columns:
            keep &= F.col("order_day") == run_date.day
    elif scope != "month":
        raise ValueError(f"scope must be 'day' or 'month', got {scope!r}")
    return df.filter(keep)


def quality_rules(strict: bool = False) -> list[Rule]:
    message = fv.QUALITY_MESSAGES
    listed = [Rule("records_present", message["records_present"], rules.no_rows())]
    listed.append(Rule("order_id_not_null", message["order_id_not_null"], rules.nulls("order_id")))
    for column in ("quantity", "price", "total_amount"):
        name = f"{column}_positive"
        listed.append(Rule(name, message[name], rules.not_positive(column)))
    return listed + (rules.not_null_rules("quantity", "price", "total_amount") if strict else [])


def quality_report(df: DataFrame, strict: bool = False) -> DataFrame:
    return rules.report(df, quality_rules(strict))


def gate(report: DataFrame) -> None:
    """Raise with every failed rule, in order. The report has one row per rule."""
    failed = rules.failures(report).orderBy("position").collect()
    if failed:
        raise DataQualityError([(r.rule, r.message, r.violations) for r in failed])

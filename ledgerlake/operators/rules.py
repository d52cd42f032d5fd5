"""Counting rule violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    message: str
    violations: Column  # an aggregate


def no_rows() -> Column:
    return F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)


def nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def not_positive(column: str) -> Column:
    """Null and NaN compare neither as zero nor below, so they are not counted."""
    return F.count_if(F.col(column) <= 0)


def not_null_rules(*columns: str) -> list[Rule]:
    """What strict checking adds: values the other rules let through as unknown, null
    or NaN."""
    unknown = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c)))
    return [Rule(f"{c}_not_null", f"{c} contains NULL values", unknown(c)) for c in columns]


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule, in order, from a single pass over the data.

    All counts are terms of one aggregate, so each task sends on one row whatever
    the number of rules; the row is then turned into rows.
    """
    counted = df.agg(*(r.violations.cast("bigint").alias(r.name) for r in rules))
    return counted.select(F.inline(F.array(*(
        F.struct(
            F.lit(position).alias("position"),
            F.lit(r.name).alias("rule"),
            F.lit(r.message).alias("message"),
            F.col(r.name).alias("violations"),
            (F.col(r.name) == 0).alias("passed"),
        )
        for position, r in enumerate(rules, start=1)
    ))))


def failures(report_: DataFrame) -> DataFrame:
    return report_.filter(~F.col("passed"))


def first_failure(report_: DataFrame) -> DataFrame:
    return failures(report_).orderBy("position").limit(1)

"""From a landed sale to a processed one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import sales


def enrich(df: DataFrame, run_date: dt.date | Column, loaded_at: Column | None = None) -> DataFrame:
    """All derived columns in one projection: no shuffle, and it fuses with the scan. The run
    date is one for all rows, or a column where the batches of many days are read together."""
    day = sales.parsed_date(F.col("order_date"))
    year, month = F.year(day), F.month(day)
    return df.withColumns({
        "order_date": day,
        "order_year": year,
        "order_month": month,
        "order_day": F.dayofmonth(day),
        "order_year_month": sales.year_month(year, month),
        "total_amount": sales.total_amount(F.col("quantity"), F.col("price")),
        "price_bucket": sales.price_bucket(F.col("price")),
        "processing_date": (
            F.date_format(run_date, "yyyy-MM-dd") if isinstance(run_date, Column) else F.lit(run_date.isoformat())),
        "ingestion_timestamp": F.current_timestamp() if loaded_at is None else loaded_at,
    })

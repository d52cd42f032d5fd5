"""Column contracts of each zone. Reads never infer: every reader takes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.errors import SchemaMismatch

PRODUCT = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
])

CUSTOMER = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("city", T.StringType()),
])

RAW = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("city", T.StringType()),
    T.StructField("payment_type", T.StringType()),
])

# Order numbers given to a day, one row per day.
ORDER_RANGE = T.StructType([
    T.StructField("first_number", T.LongType()),
    T.StructField("last_number", T.LongType()),
    T.StructField("run_date", T.DateType()),
])

STAMPS = T.StructType([
    T.StructField("ingestion_date", T.DateType()),
    T.StructField("source_system", T.StringType()),
])


def _as_text(schema: T.StructType, column: str) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == column else f.dataType)
        for f in schema
    ])


# In a file the order date is text: an unreadable date must become null in the
# enrichment, as it would under inference, and not abort the scan.
RAW_FILE = _as_text(RAW, "order_date")
LANDED = T.StructType(RAW_FILE.fields + STAMPS.fields)

PROCESSED = T.StructType(RAW.fields + STAMPS.fields + [
    T.StructField("order_year", T.IntegerType()),
    T.StructField("order_month", T.IntegerType()),
    T.StructField("order_day", T.IntegerType()),
    T.StructField("order_year_month", T.StringType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("price_bucket", T.StringType()),
    T.StructField("processing_date", T.StringType()),
    T.StructField("ingestion_timestamp", T.TimestampType()),
])


def fact(id_type: T.DataType = T.IntegerType()) -> T.StructType:
    """The published table. The target declares INT ids; pass LongType() for a
    target widened to BIGINT, which order numbers past 2**31-1 need."""
    return T.StructType([
        T.StructField("order_id", id_type, nullable=False),
        T.StructField("product_id", id_type),
        T.StructField("customer_id", id_type),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("total_amount", T.DecimalType(12, 2)),
        T.StructField("price_bucket", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("order_year", T.IntegerType()),
        T.StructField("order_month", T.IntegerType()),
        T.StructField("processing_date", T.DateType()),
    ])


FACT = fact()

# Declared widths that a Spark type cannot carry, for table creation over JDBC.
FACT_COLUMN_TYPES = "price_bucket VARCHAR(20)"


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Check names, order and types without running a job."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if found != wanted:
        missing = [c for c in wanted if c not in found]
        surplus = [c for c in found if c not in wanted]
        raise SchemaMismatch(
            f"schema differs: missing {missing}, unexpected {surplus}"
            if missing or surplus
            else f"columns out of order: {[n for n, _ in found]}"
        )
    return df

"""The published fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.functions import ids


def project(processed: DataFrame) -> DataFrame:
    """The 11 published columns, still with the processed table's types."""
    return processed.select(*schemas.FACT.names)


def typed(projected: DataFrame, id_type: T.DataType = T.IntegerType()) -> DataFrame:
    """Cast to the declared types. Ids lose their prefix, and one that does not fit
    stops the job."""
    columns = {f.name: F.col(f.name).cast(f.dataType) for f in schemas.fact(id_type)}
    columns["order_id"] = ids.number_of(F.col("order_id"), fv.ORDER_PREFIX, id_type, required=True)
    columns["product_id"] = ids.number_of(F.col("product_id"), fv.PRODUCT_PREFIX, id_type)
    columns["customer_id"] = ids.number_of(F.col("customer_id"), fv.CUSTOMER_PREFIX, id_type)
    return projected.select(*(c.alias(name) for name, c in columns.items()))


def preview(fact: DataFrame, rows: int = fv.PREVIEW_ROWS) -> DataFrame:
    """The first rows in a fixed order: each task keeps only `rows` of them."""
    return fact.orderBy(*fact.columns).limit(rows)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows_to_load"))

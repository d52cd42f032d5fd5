"""Publishing over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.errors import PublishMismatch
from ledgerlake.sources.files import observed


def url(server: str, database: str) -> str:
    """TLS on, server certificate checked, 30 s login timeout."""
    return fv.JDBC_URL.format(server=server, database=database)


def connection(url_: str, **given: str) -> dict[str, str]:
    """Options for one target. User and password come from the caller, as does any
    other driver."""
    return {"url": url_, "dbtable": fv.FACT_TABLE, "driver": fv.JDBC_DRIVER, **given}


def write_options(connections: int, batch_size: int) -> dict[str, str]:
    """`truncate` empties the table rather than dropping it, so its declared types
    stay. `numPartitions` bounds how many tasks write, and so connect, at a time."""
    return {
        "truncate": "true",
        "numPartitions": str(connections),
        "batchsize": str(batch_size),
        "createTableColumnTypes": schemas.FACT_COLUMN_TYPES,
    }


def replace_table(
    df: DataFrame, target: Mapping[str, str], connections: int = 16, batch_size: int = 10_000
) -> None:
    """Replace the target's rows with those of `df`."""
    options = {**write_options(connections, batch_size), **target}
    df.write.format("jdbc").options(**options).mode("overwrite").save()


def row_count(spark: SparkSession, target: Mapping[str, str]) -> int:
    """Rows in the target, counted by the database."""
    connect = {k: v for k, v in target.items() if k != "dbtable"}
    counted = f"(SELECT COUNT(*) AS published FROM {target['dbtable']}) counted"
    return int(spark.read.format("jdbc").options(**connect, dbtable=counted).load().first()[0])


def check_count(spark: SparkSession, target: Mapping[str, str], sent: int) -> None:
    """Each task commits its rows in one transaction, but a task lost between its
    commit and its report runs again and inserts them twice. A replace is complete
    only if the counts agree; otherwise repeat it."""
    published = row_count(spark, target)
    if published != sent:
        raise PublishMismatch(f"sent {sent} rows, target holds {published}")


def publish_staged(
    df: DataFrame, folder: str, target: Mapping[str, str], staging: str, swap: Callable[[], None],
    connections: int = 16, batch_size: int = 10_000,
) -> int:
    """Replace the target so that its readers see the old rows or the new ones, never a part.

    All tasks write the rows to `folder` first, as many at a time as the cluster has room for, and
    count them; the few connections then only copy finished files into the table `staging`. When the
    database counts as many rows there as were written, `swap` is called, which puts the staging table
    in the target's place as the database does that (renames in one transaction). A failure before
    that leaves the target as it was. Returns the rows."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder)
    rows = observed(counted).get("rows", 0)
    staged = df.sparkSession.read.schema(df.schema).parquet(folder)
    beside = {**target, "dbtable": staging}
    replace_table(staged, beside, connections, batch_size)
    check_count(df.sparkSession, beside, rows)
    swap()
    return rows

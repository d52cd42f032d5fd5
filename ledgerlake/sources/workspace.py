"""Directories for tables a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a session that
    runs in one process may fall back to a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir()


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/ledgerlake-{uuid.uuid4().hex}"

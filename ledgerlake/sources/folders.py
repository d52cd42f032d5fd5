"""What is stored under a path, on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files directly under a path; none if it is not there."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(str(s.getPath()) for s in system.listStatus(place) if s.isFile())


def size(spark: SparkSession, path: str) -> int:
    """Bytes stored under a path; 0 if there is nothing."""
    system, place = _at(spark, path)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def partition_keys(spark: SparkSession, path: str) -> list[str]:
    """The partition columns of a table, by the names of the first directory at each level."""
    system, place = _at(spark, path)
    keys: list[str] = []
    while system.exists(place):
        below = [s.getPath() for s in system.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            break
        place = below[0]
        keys.append(place.getName().split("=")[0])
    return keys

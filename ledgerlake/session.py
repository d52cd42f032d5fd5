"""Session settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# Run-time re-planning carries the joins: it sizes shuffle partitions, turns a join
# into a broadcast when a side proves small, and splits a hot key over tasks.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Also the target size of the files a rebalanced write makes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # A join whose smaller side has no partition above this is hashed, not sorted. It
    # takes effect only when it is no less than the size above.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

# How the files of a finished job become visible, by the scheme of the path they are under. The
# first committer of a list is the default. "Manifest" committers list their files instead of
# renaming folders, and can replace single partitions. S3's cannot: there a day is replaced with a
# table format, or with the plain committer and its slow copies.
_CLOUD_PROTOCOL = {
    "spark.sql.sources.commitProtocolClass": "org.apache.spark.internal.io.cloud.PathOutputCommitProtocol",
    "spark.sql.parquet.output.committer.class": "org.apache.spark.internal.io.cloud.BindingParquetOutputCommitter",
}
_AZURE = {"spark.hadoop.mapreduce.outputcommitter.factory.scheme.{scheme}":
          "org.apache.hadoop.fs.azurebfs.commit.AzureManifestCommitterFactory", **_CLOUD_PROTOCOL}
_GOOGLE = {"spark.hadoop.mapreduce.outputcommitter.factory.scheme.{scheme}":
           "org.apache.hadoop.mapreduce.lib.output.committer.manifest.ManifestCommitterFactory", **_CLOUD_PROTOCOL}
_S3 = {"spark.hadoop.fs.s3a.committer.name": "{committer}", **_CLOUD_PROTOCOL}
_PLAIN = {"spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "1"}
COMMITTERS = {
    "abfs": {"manifest": _AZURE, "plain": _PLAIN},
    "abfss": {"manifest": _AZURE, "plain": _PLAIN},
    "gs": {"manifest": _GOOGLE, "plain": _PLAIN},
    "s3a": {"plain": _PLAIN, "directory": _S3, "magic": _S3},
}
REPLACES_PARTITIONS = {"plain", "manifest"}


def committer_for(path: str, committer: str | None = None, replaces_days: bool = False) -> dict[str, str]:
    """Session settings for jobs that write under a path. The cloud committers need Spark's
    hadoop-cloud module, which also brings the file systems. `replaces_days` refuses a committer
    that cannot replace single partitions."""
    scheme = path.split("://")[0] if "://" in path else "file"
    known = COMMITTERS.get(scheme, {"plain": _PLAIN})
    committer = committer or next(iter(known))
    if committer not in known:
        raise ValueError(f"no committer {committer!r} for {scheme}: one of {sorted(known)}")
    if replaces_days and committer not in REPLACES_PARTITIONS:
        raise ValueError(f"the committer {committer!r} cannot replace single partitions")
    return {k.format(scheme=scheme): v.format(committer=committer) for k, v in known[committer].items()}


SHUFFLE_PARTITION_BYTES = 128 * 1024**2


def sized_for(input_bytes: int) -> dict[str, str]:
    """Shuffle partitions for an input. Run-time re-planning joins partitions that
    prove small but cannot make more of them, so their number starts high enough
    that none outgrows an executor."""
    wanted = -(-input_bytes // SHUFFLE_PARTITION_BYTES)
    return {"spark.sql.shuffle.partitions": str(max(wanted, 200))}


TABLE_FORMATS = {
    "parquet": {},
    "delta": {
        "spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
        "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
    },
}


def session(
    name: str = "ledgerlake", conf: Mapping[str, str] | None = None, fmt: str = "parquet",
    lake: str = "", committer: str | None = None,
) -> SparkSession:
    """A session with these settings; the caller's `conf` wins. `lake` is the path that jobs
    write under, which decides their committer. Master, resources, shuffle partitions and
    storage credentials are the caller's to give."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **committer_for(lake, committer), **TABLE_FORMATS[fmt], **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

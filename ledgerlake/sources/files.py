"""Raw CSV batches and JSON dimensions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.errors import MissingInput
from ledgerlake.functions import params
from ledgerlake.sources import folders


# Quotes are doubled inside quoted text, as other CSV writers do. Empty text and null
# look alike in such a file, and both read back as null.
# Blanks around text are kept, which the writer would trim by default.
CSV = {
    "header": True, "dateFormat": fv.DATE_FORMAT, "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def loading(load, what) -> DataFrame:
    """Run a load, naming the input when it is not there."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"no input at {what}") from e
        raise


# The text of a record that does not fit its types, beside the columns that do.
RECORD = "_malformed_record"
# A file whose records may hold line breaks is read by one task, so files are kept small.
RECORDS_PER_FILE = 1_000_000


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = schemas.LANDED,
    infer: bool = False,
    malformed: str = "fail",
    line_breaks: bool = False,
) -> DataFrame:
    """Scan CSV batches by the names in their header.

    The header row is read first, since under an explicit schema a missing column
    would come back as null: the frame has exactly the file's columns, those of
    `schema` with its types and others as text. Every file's header is checked
    against it while scanning. A value that is not of its type, or a record of
    another length, stops the job; with `malformed="keep"` such a record comes back
    with its text in RECORD, which is null in all others. `line_breaks` reads
    records that run over lines, and each file then in one task. `infer` reads
    types from the data instead, at the cost of another pass.
    """
    reader = spark.read.options(**CSV).option("multiLine", line_breaks)
    if infer:
        return loading(lambda: reader.option("inferSchema", True).csv(paths), paths)
    header = loading(lambda: reader.csv(paths), paths).columns
    types = {f.name: f.dataType for f in schema}
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = reader.option("enforceSchema", False)
    if malformed == "fail":
        return reader.option("mode", "FAILFAST").schema(found).csv(paths)
    if malformed != "keep":
        raise ValueError(f"malformed must be 'fail' or 'keep', got {malformed!r}")
    # Without pruning every value is read, whatever columns are asked for later.
    reader = reader.option("mode", "PERMISSIVE").option("columnPruning", False)
    return reader.option("columnNameOfCorruptRecord", RECORD).schema(found.add(RECORD, T.StringType())).csv(paths)


def write_csv(df: DataFrame, path: str, line_breaks: bool = False) -> None:
    """One batch as a directory of CSV parts, each with the header.

    Text with a line break stops the job by the column's name, since a reader that
    splits files at line ends could not read it. With `line_breaks` it is written,
    in files of bounded size, for readers told the same.
    """
    if line_breaks:
        writer = df.write.option("maxRecordsPerFile", RECORDS_PER_FILE)
    else:
        writer = df.select(*(_on_one_line(f) for f in df.schema)).write
    writer.mode("overwrite").options(**CSV).csv(path)


def _on_one_line(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        return column
    message = F.lit(f"column {field.name} holds a line break; write it with line_breaks")
    broken = F.contains(column, F.lit("\n")) | F.contains(column, F.lit("\r"))
    return F.when(broken, F.raise_error(message).cast("string")).otherwise(column).alias(field.name)


def land_raw(df: DataFrame, zone: str, day: dt.date, line_breaks: bool = False) -> str:
    """Create or replace a day's batch in a zone; returns its path."""
    path = params.raw_path(zone, day)
    write_csv(df, path, line_breaks)
    return path


def observed(seen: Observation) -> dict[str, int]:
    """What a finished job counted; nothing if planning found the counted frame empty and dropped
    it from the job."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


def quarantine_malformed(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Split what `read_csv(malformed="keep")` found: the whole records, and the number of
    the others, which are stored under `path`, text and what could be read of it, in place of
    an earlier run's."""
    spark = df.sparkSession
    counted = Observation()
    broken = df.filter(F.col(RECORD).isNotNull())
    broken.observe(counted, F.count(F.lit(1)).alias("records")).write.mode("overwrite").parquet(path)
    records = observed(counted).get("records", 0)
    if not records:
        folders.remove(spark, path)
    return df.filter(F.col(RECORD).isNull()).drop(RECORD), records


def read_json(spark: SparkSession, path: str, schema: T.StructType, array: bool = False) -> DataFrame:
    """Scan a dimension kept as JSON Lines, or as one JSON array per file. An array
    cannot be split, so it is for dimensions of catalogue size only."""
    reader = spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST")
    return loading(lambda: reader.json(path), path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines, which any number of tasks can write and read."""
    df.write.mode("overwrite").json(path)

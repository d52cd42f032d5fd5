"""What the operators share: reading a table, cutting lineage, hashing words."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where none is named and all
    runs in one process, as in tests, one beside the session's tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def spare(name: str, df: DataFrame) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there, so
    a lost executor costs at most the step after it. Removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a `durable` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getName().startswith("llm-"):
            raise ValueError(f"not a durable table: {path}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """With these columns, each worked out once per row: the optimiser does not copy an
    expression past the generator that yields its one value."""
    once, made = F.explode_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))), spare("held", df)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", once.alias(made)).select(*kept, *(F.col(f"{made}.{n}") for n in columns))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts reach Python in batches of few rows, so that long ones fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_bytes(column: str = "text"):
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_key(column: str = "text"):
    """128 bits that stand for a text, so that copies meet without their text."""
    return F.unhex(F.md5(text_bytes(column)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANKS = [32, 9, 10, 11, 12, 13]


def _byte_values() -> np.ndarray:
    """A random 64-bit value per byte; capitals have that of their small letter, blanks 0."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    values[65:91] = values[97:123]
    values[_BLANKS] = 0
    return values


_VALUES = _byte_values()
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[_BLANKS] = False
_powers = np.ones(1, dtype=np.uint64)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of some UTF-8 texts, in order, and where each text's words
    begin, with the end of the last. Words stand between blanks (0x20, 0x09-0x0D); A-Z count
    as a-z, other letters as they are."""
    global _powers
    data = np.frombuffer(b"\n".join([b"", *texts]), dtype=np.uint8)
    inside = _INSIDE[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends, side="right")])
    if not len(starts):
        return np.empty(0, dtype=np.uint64), bounds
    lengths = np.diff(starts, append=len(data))
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.multiply.accumulate(
            np.concatenate([[np.uint64(1)], np.full(2 * longest, np.uint64(0xD1342543DE82EF95))]))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_VALUES[data[starts[0]:]] * _powers[place], starts - starts[0])), bounds


def shingle_sets(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of runs of `width` words, sorted; the whole sequence
    as one run when there are fewer words, nothing when there are none."""
    words, bounds = word_hashes(texts)
    sets = []
    rolled = _rolled(words, width)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= width:
            sets.append(np.unique(rolled[start : end - width + 1]))
        else:
            sets.append(_rolled(words[start:end], end - start) if end > start else words[:0])
    return sets


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, whatever text they are in."""
    count = max(0, len(words) - width + 1)
    rolled = np.full(count, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled + words[k : k + count] + GOLDEN)
    return rolled

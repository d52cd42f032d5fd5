"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import durable, shingle_sets, small_batches, text_bytes, text_key

WIDTH = 5  # words in a shingle
SCALE = 2  # one hash in so many is kept; short texts need many to be seen in long ones
BLOCK = 512  # doc_ids in a block
DIGIT = 10  # bits of a block number that one window sees

OUT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def sketch(elements: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The hashes below 2^64 / scale, sorted; the least one if none is. Sketches of two
    sets merge into that of their union: see `merged`. A least one above the threshold only
    tells equal sets from others; of n shingles none is below it once in (scale / (scale - 1))^n."""
    if not len(elements):
        return elements
    kept = elements[elements < np.uint64(2**64 // scale)]
    return kept if len(kept) else elements.min(keepdims=True)


def merged(one: np.ndarray, other: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two sets, from their sketches."""
    return sketch(np.union1d(one, other), scale)


def contained(one: np.ndarray, other: np.ndarray) -> float:
    """How much of the smaller set the larger one holds, 0 to 1, as the sketches tell.
    Two empty sets are alike; an empty and another one are not. Nothing is known of a set
    without a hash below the threshold but whether it is the same: 0 beside any other."""
    least = min(len(one), len(other))
    if not least:
        return float(len(one) == len(other))
    return len(np.intersect1d(one, other, assume_unique=True)) / least


def written(kept: np.ndarray) -> str:
    """16 hex digits per hash, ascending."""
    return kept.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def sketches(texts: Sequence[bytes], width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    return [sketch(found, scale) for found in shingle_sets(texts, width)]


def successors(blocks: DataFrame, lowest: int, highest: int) -> DataFrame:
    """(block, above): the next larger block number there is, null for the largest. A
    window sees at most 2^DIGIT blocks: those that share all higher bits. The largest of
    each such group is followed by the least block of the next group, found the same way."""
    if highest - lowest < 2**DIGIT:
        return blocks.select("block", F.lead("block").over(Window.orderBy("block")).alias("above"))
    grouped = blocks.withColumn("group", F.shiftright("block", DIGIT))
    inside = grouped.withColumn("above", F.lead("block").over(Window.partitionBy("group").orderBy("block")))
    least = durable(grouped.groupBy("group").agg(F.min("block").alias("least")))
    order = successors(
        least.select(F.col("group").alias("block")), lowest >> DIGIT, highest >> DIGIT
    ).select(F.col("block").alias("group"), F.col("above").alias("next_group"))
    first = least.select(F.col("group").alias("next_group"), "least")
    then = order.join(first, "next_group", "left").select("group", "least")
    return inside.join(then, "group", "left").select("block", F.coalesce("above", "least").alias("above"))


def _place(lowest: int) -> Column:
    """Where a document stands; descending. Documents without doc_id come last, by text."""
    unnumbered = F.lit(lowest - 1) - F.shiftrightunsigned(F.xxhash64("text"), 24)
    return F.coalesce(F.col("doc_id").cast("long"), unnumbered)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """The length of a text in code points; the text with its last third of them replaced
    by the first as many of the following one."""
    whole = text.decode()
    third = len(whole) // 3
    # A code point has at most 4 bytes; one cut at the end is beyond the third.
    start = following[: 4 * third].decode(errors="ignore")[:third]
    return len(whole), (whole[: len(whole) - third] + start).encode()


def _editor(width: int, scale: int):
    def edit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document so far, until the next one is there
        for part in parts:
            columns = (part.column(c).to_pylist() for c in ("doc_id", "block", "context", "text"))
            pairs = []
            rows = list(zip(*columns, sketches(part.column("text").to_pylist(), width, scale)))
            for row in rows:
                if held is not None and held[1] == row[1]:
                    pairs.append((held, row))
                held = None if row[2] else row
            done = [edited(one[3], other[3]) for one, other in pairs]
            changed = sketches([text for _, text in done], width, scale)
            out = [
                (one[0], size, hashlib.sha256(text).hexdigest(), written(one[4]), written(after),
                 contained(one[4], after), contained(one[4], other[4]))
                for (one, other), (size, text), after in zip(pairs, done, changed)
            ]
            columns = zip(*out) if out else [()] * len(OUT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, OUT.values())], names=list(OUT)
            )

    return edit


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text is compared with itself after an edit, and with the next document by descending
    doc_id (after the last: the first). The edit replaces the last floor(n_chars / 3) code
    points by the first as many of the next document. Null texts are empty; rows of the same
    doc_id follow each other by text; rows without doc_id come last. Other columns are ignored.
    Of a text with few shingles (under ten or so) the sketch may hold none: see sketch().

    Texts move once: to the block of their doc_id, at most `block` numbers wide. The first
    document of each block also goes to the block above it, whose last document it follows."""
    spark = docs.sparkSession
    small_batches(spark)
    lowest, highest = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    lowest, highest = lowest or 0, highest or 0
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = placed.select(
        "doc_id", _place(lowest).alias("place"), text_key().alias("node"), text_bytes().alias("text")
    ).withColumn("block", F.floor(F.col("place") / block).cast("long"))
    heads = durable(
        placed.groupBy("block").agg(F.max(F.struct("place", "node")).alias("head"))
        .select("block", "head.place", "head.node")
    )
    ends = heads.agg(F.min("block"), F.max("block")).first()
    if ends[0] is None:
        ends = (0, 0)
    above = durable(successors(heads.select("block"), *ends))
    # The head of a block is what follows the last document of the block above it; the
    # head of all follows the last document of the lowest block.
    follows = durable(
        heads.join(above, "block").select("place", "node", F.coalesce("above", F.lit(ends[0])).alias("to"))
    )
    context = placed.join(follows, ["place", "node"]).select(
        "doc_id", "place", "node", "text", F.col("to").alias("block")
    )
    context = context.dropDuplicates(["place", "node"]).withColumn("context", F.lit(True))
    rows = placed.select("doc_id", "place", "node", "text", "block").withColumn("context", F.lit(False))
    ordered = (
        rows.unionByName(context).repartition("block")
        .sortWithinPartitions("block", "context", F.desc("place"), F.desc("node"))
    )
    return ordered.select("doc_id", "block", "context", "text").mapInArrow(
        _editor(width, scale),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )

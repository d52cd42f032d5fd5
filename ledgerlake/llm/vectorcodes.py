"""Vector codes: each part of a vector is named by its nearest codebook entry.

Codebooks are learnt in Lloyd rounds with Drake and Hamerly's adaptive bounds. A part keeps its b
closest entries in order, a lower bound of its distance to each of them but the first, and one outer
bound for all entries outside the list. When entries move, bounds shrink by the moves. The entries
whose bound still exceeds the distance to the part's own entry cannot be nearest; only the others
are compared, in integers. b follows what the round before needed.

What goes through the driver is the codebooks (256 entries of the vector's length) and their sums.
The state of a round is a written table; the one before it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import durable, forget

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 32768.0  # components of this size or more count as not finite
MOST, LEAST = 16, 4  # entries a part keeps in the first round, and at least
SETTLED = 0.99  # of the parts must find their entry within the list that the next round keeps
ROWS = 2048  # vectors that are worked on at once

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # closest entries, bounds, squares, entries looked at


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding, without vectors that are null or hold a null, a NaN, an infinity
    or a component of LARGEST or more."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.select("vec_id", label, "embedding").filter(F.col("embedding").isNotNull() & fine)


def _integers(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(rows, -1)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every entry, exact."""
    size = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * size * size * max(1, x.shape[1]) < 2.0**52:  # sums of products are then exact in doubles
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    all_ = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    return all_.astype(np.int64)


def _below(x: np.ndarray) -> np.ndarray:
    """A single-precision number under x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _all_entries(x: np.ndarray, entries: np.ndarray, kept: int) -> Found:
    """The `kept` closest entries of each row, by distance and then by index, and their bounds."""
    squares, k = _squares(x, entries), len(entries)
    if squares.max(initial=0) < 2**54:
        keys = squares * 256 + np.arange(k)
        if kept < k:
            keys = np.partition(keys, kept, axis=1)[:, : kept + 1]
        keys = np.sort(keys, axis=1)
        order, found = keys & 255, keys >> 8
    else:
        order = np.argsort(squares, axis=1, kind="stable")[:, : kept + 1]
        found = np.take_along_axis(squares, order, 1)
    outer = found[:, kept] if kept < k else np.full(len(x), np.inf)
    bounds = np.column_stack([found[:, 1:kept], outer])
    looked = np.full(len(x), k, dtype=np.int64)
    return order[:, :kept].astype(np.uint8), _below(np.sqrt(bounds.astype(np.float64))), found[:, 0], looked


def _bounded(x: np.ndarray, entries: np.ndarray, near: np.ndarray, low: np.ndarray, moved: np.ndarray) -> Found:
    """What `_all_entries` finds of the nearest entry, by looking only where the bounds leave doubt."""
    near, kept = near.copy(), near.shape[1]
    shrunk = low.astype(np.float64)
    shrunk[:, :-1] -= moved[near[:, 1:]]
    # The outer bound shrinks by the largest move of an entry that is not in the list.
    most = np.argsort(-moved)[: kept + 1]
    inside = (near[:, None, :] == most[None, :, None]).any(2)
    shrunk[:, -1] -= moved[most[inside.argmin(1)]]
    shrunk = np.minimum.accumulate(shrunk[:, ::-1], axis=1)[:, ::-1]
    low = _below(shrunk)
    best = ((x - entries[near[:, 0]]) ** 2).sum(1)
    reach = np.nextafter(np.sqrt(best.astype(np.float64)), np.inf)
    doubtful = (low <= reach[:, None]).sum(1)
    looked = doubtful + 1
    for count in np.unique(doubtful).tolist():
        if count == 0:
            continue
        rows = np.flatnonzero(doubtful == count)
        if count == kept:
            near[rows], low[rows], best[rows], looked[rows] = _all_entries(x[rows], entries, kept)
            continue
        asked = near[rows, : count + 1].astype(np.int64)
        squares = ((x[rows][:, None, :] - entries[asked]) ** 2).sum(2)
        order = np.lexsort((asked, squares), axis=-1)
        squares = np.take_along_axis(squares, order, 1)
        near[rows, : count + 1] = np.take_along_axis(asked, order, 1)
        low[rows, :count] = _below(np.sqrt(squares[:, 1:].astype(np.float64)))
        best[rows] = squares[:, 0]
    return near, low, best, looked


class Learner:
    """One pass over the vectors with given codebooks, as a function of Arrow batches."""

    def __init__(self, codebooks: np.ndarray, kept: int, moved: np.ndarray | None, last: bool):
        self.codebooks, self.kept, self.moved, self.last = codebooks, kept, moved, last

    def _assigned(self, part: int, x: np.ndarray, batch: pa.RecordBatch, start: int, rows: int) -> Found:
        entries = self.codebooks[part]
        if self.moved is None:
            return _all_entries(x, entries, self.kept)
        wide, width = _wide(batch.column("near"), np.uint8, start, rows), min(self.kept, len(entries))
        before = wide.reshape(rows, PARTS, -1)[:, part]
        low = _wide(batch.column("low"), np.float32, start, rows).reshape(rows, PARTS, -1)[:, part]
        if width < before.shape[1]:  # a shorter list: the outer bound covers what leaves it
            low = np.column_stack([low[:, : width - 1], low[:, width - 1 :].min(1)])
            before = before[:, :width]
        return _bounded(x, entries, before, low, self.moved[part])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = self.codebooks.shape[1:]
        sums, counts = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        looked_at, empty = np.zeros(ENTRIES + 1, np.int64), True
        ids = None
        for batch in batches:
            ids = (batch.schema.field("vec_id").type, batch.schema.field("label").type)
            for start in range(0, batch.num_rows, ROWS):
                rows, empty = min(ROWS, batch.num_rows - start), False
                if self.moved is None:
                    x = _integers(_wide(batch.column("embedding"), None, start, rows), rows)
                else:
                    x = _wide(batch.column("x"), np.int32, start, rows).astype(np.int64)
                found = []
                for part in range(PARTS):
                    own = x[:, part * width : (part + 1) * width]
                    found.append(self._assigned(part, own, batch, start, rows))
                    entry = found[-1][0][:, 0]
                    if not self.last:
                        order = np.argsort(entry, kind="stable")
                        at = np.flatnonzero(np.diff(entry[order], prepend=-1))
                        sums[part, entry[order][at]] += np.add.reduceat(own[order], at, axis=0)
                        counts[part] += np.bincount(entry, minlength=k)
                        looked_at += np.bincount(found[-1][3], minlength=len(looked_at))
                yield self._rows(batch.slice(start, rows), x, found)
        if not empty and not self.last:
            total = np.concatenate([looked_at, counts.ravel(), sums.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids[0]), pa.nulls(1, ids[1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))],
                names=["vec_id", "label", "x", "near", "low", "sums"])

    def _rows(self, batch: pa.RecordBatch, x: np.ndarray, found: list[Found]) -> pa.RecordBatch:
        ids = [batch.column("vec_id"), batch.column("label")]
        if self.last:
            codes = np.stack([f[0][:, 0] for f in found], axis=1)
            error = sum(f[2] for f in found)
            return pa.RecordBatch.from_arrays(
                [*ids, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])
        packed = [x.astype(np.int32), np.concatenate([f[0] for f in found], axis=1), np.concatenate([f[1] for f in found], axis=1)]
        return pa.RecordBatch.from_arrays(
            [*ids, *(_binary(a) for a in packed), pa.nulls(len(x), pa.list_(pa.int64()))],
            names=["vec_id", "label", "x", "near", "low", "sums"])


def _wide(column: pa.Array, kind: type | None, start: int, rows: int) -> np.ndarray:
    """The values of lists, or of binaries that hold numbers of a kind, of some rows of one width."""
    if kind is None:
        return column.slice(start, rows).flatten().to_numpy(zero_copy_only=False)
    data = b"".join(column.slice(start, rows).to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(rows, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _state(vectors: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in vectors.schema}
    return T.StructType([
        T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]),
        *(T.StructField(c, T.BinaryType()) for c in ("x", "near", "low")),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ])


def _coded(vectors: DataFrame) -> T.StructType:
    return T.StructType([*_state(vectors).fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def learnt(vectors: DataFrame, observe: Callable[[int, int, np.ndarray], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes of `usable` vectors (vec_id, label, code, error) and the codebooks (part, entry, position).

    The vector of the least vec_id sets the length; vectors of another length are left out, and what
    remains beyond four equal parts does not count. `observe` is told each round, its b and how many
    parts looked at how many entries."""
    length = vectors.select(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", "embedding"))).first()[0]
    width = (length or 0) // PARTS
    vectors = vectors.filter(F.size("embedding") == (length or 0))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES)
    seeds = [list(r[0]) for r in first.collect()]
    if not seeds:
        return vectors.sparkSession.createDataFrame([], _coded(vectors)), np.zeros((PARTS, 0, 0), np.int64)
    start = _integers(np.array(seeds).ravel(), len(seeds))[:, : PARTS * width]
    books = start.reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    kept, moved, state = min(MOST, len(seeds)), None, vectors
    for round_ in range(ROUNDS):
        following = durable(state.mapInArrow(Learner(books, kept, moved, last=False), _state(vectors)))
        if moved is not None:
            forget(state)
        looked_at, counts, sums = _totals(following, books.shape)
        if observe:
            observe(round_, kept, looked_at)
        after = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved = np.nextafter(np.sqrt(((after - books) ** 2).sum(2).astype(np.float64)), np.inf)
        moved[(after == books).all(2)] = 0.0
        if round_:  # in the first round all look at everything
            within = np.cumsum(looked_at)
            enough = int(np.searchsorted(within, SETTLED * within[-1]))
            kept = min(kept, max(LEAST, enough))
        books, state = after, following.filter(F.col("sums").isNull())
    coded = durable(state.mapInArrow(Learner(books, kept, moved, last=True), _coded(vectors)))
    forget(state)
    return coded, books


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tasks' sums added up: one value for each component of each entry."""
    added = (
        state.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "n"))
        .groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    )
    total = np.zeros(ENTRIES + 1 + shape[0] * shape[1] * (1 + shape[2]), np.int64)
    total[added["at"].to_numpy()] = added["n"].to_numpy()
    looked_at, rest = total[: ENTRIES + 1], total[ENTRIES + 1 :]
    cut = shape[0] * shape[1]
    return looked_at, rest[:cut].reshape(shape[:2]), rest[cut:].reshape(shape)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable vector.

    Rows that share a vec_id each get a row; those without one come after all others when the first
    codebooks are chosen. Of fewer than 256 vectors each is an entry. Equal vectors are equal entries,
    of which the first is used. An empty table gives no rows; further columns are not looked at."""
    codes, books = learnt(usable(vectors))
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    same: Column = F.col("c.label").eqNullSafe(F.col("l.label"))
    return codes.alias("c").join(of_label.alias("l"), same).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

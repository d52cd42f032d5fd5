"""Passages that repeat across documents, found with suffix arrays.

Every string of LENGTH bytes is to be looked up in all other documents. Suffixes go to shards by what
they hold: a string belongs to the shard of its minimizer, the least hash of its GRAM-byte pieces, so
equal strings meet whatever documents they are in. Neighbouring strings with one minimizer travel
together as a piece of at most 2 * LENGTH bytes. In a shard the pieces' suffixes are sorted by
Larsson and Sadakane's refinement (order by h bytes gives order by 2h, only undecided groups are
sorted again), Kasai's method gives the common prefixes of neighbours, and a run of neighbours with
LENGTH bytes in common is one string; the least doc_id of the run decides. A shard with more pieces
than one suffix array should have is cut into several, whose sorted strings are merged by binary
search.

Equal pieces are put together before they travel: within a task's batch only the least document of a
piece stands for it, and the others are already known to repeat it. So copies cost a row for each
batch, not for each document. Pieces without a neighbourhood (the minimizer and REACH bytes on
either side) that is seen in another document cannot repeat and are not sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import mix, text_bytes

LENGTH = 50
GRAM = 12
REACH = (LENGTH - GRAM + 1) // 2
STRETCH = 1 << 21  # bytes whose minimizers are found at once; positions must fit into PLACE_BITS
PLACE_BITS = 24
BATCH = 24 << 20  # bytes of text within which equal pieces are put together
SHARD = 1 << 24  # bytes of pieces a shard should have
ARRAY = 1 << 19  # bytes of pieces in one suffix array
BUCKET = 1 << 23  # bytes of text that are cut at once
LEVEL = 5  # of compression of what is shuffled

MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_NUMBERS = np.dtype([("length", "u1"), ("anchor", "u1"), ("document", "<i8"), ("copies", "<i4")])
_PLACES = np.dtype([("key", "<i8"), ("start", "<i8")])
_SPANS = np.dtype([("document", "<i8"), ("key", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _words(data: bytes, size: int) -> np.ndarray:
    """The integer that starts at each byte."""
    return np.ndarray(len(data) - size + 1, dtype=f"<u{size}", buffer=data, strides=(1,))


def _gram_keys(data: bytes) -> np.ndarray:
    """For each GRAM-byte piece a hash with its place in the low bits, so that the least is the leftmost."""
    count = len(data) - GRAM + 1
    h = _words(data, 8)[:count] * MULTIPLIERS[0]
    h ^= _words(data, 4)[8 : 8 + count].astype(np.uint64) * MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[2]
    return ((h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | np.arange(count, dtype=np.uint64)


def _pieces(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts that stand at some places of the data, each of LENGTH bytes at least: where
    a piece starts and ends, its text, its minimizer and where that stands in it."""
    keys = _gram_keys(data)
    width = LENGTH - GRAM + 1
    least, size = keys, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(keys) - width + 1], least[width - size : len(keys) - size + 1])
    new = np.empty(len(least), dtype=bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    text = np.searchsorted(starts, at, side="right") - 1
    limit = ends[text] - LENGTH + 1  # strings that begin here or later run into the next text
    inside = (text >= 0) & (at < limit)
    following = np.append(at[1:], len(least))
    at, text, last = at[inside], text[inside], np.minimum(following, limit)[inside]
    minimizer = least[at] >> np.uint64(PLACE_BITS)
    place = (least[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return at, last + LENGTH - 1, text, minimizer, place - at


def _stretches(texts: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (document, key, offset, bytes) of about STRETCH bytes; long texts are cut so that
    each string of LENGTH bytes stands whole in one cut."""
    group, size = [], 0
    for document, key, body in texts:
        for offset in range(0, max(len(body) - LENGTH + 1, 0), STRETCH):
            cut = body[offset : offset + STRETCH + LENGTH - 1]
            if size + len(cut) > STRETCH + LENGTH and group:
                yield group
                group, size = [], 0
            group.append((document, key, offset, cut))
            size += len(cut)
    if group:
        yield group


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Parts compressed one by one, each behind its compressed length."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    pressed = [press.compress(part if isinstance(part, bytes) else np.ascontiguousarray(part).tobytes()) for part in parts]
    return b"".join(x for part in pressed for x in (len(part).to_bytes(4, "little"), part))


def _unpacked(pack: bytes) -> Iterator[bytes]:
    press, at = zstandard.ZstdDecompressor(), 0
    while at < len(pack):
        end = at + 4 + int.from_bytes(pack[at : at + 4], "little")
        yield press.decompress(pack[at + 4 : end])
        at = end


def _columns(records: np.ndarray) -> list[np.ndarray]:
    return [records[name] for name in records.dtype.names]


def _records(kind: np.dtype, parts: Iterator[bytes]) -> np.ndarray:
    columns = {name: np.frombuffer(next(parts), kind[name]) for name in kind.names}
    out = np.empty(len(columns[kind.names[0]]), kind)
    for name, column in columns.items():
        out[name] = column
    return out


def _bundles(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the rows that have it, in their order."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
    for a, e in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
        yield int(keys[order[a]]), order[a:e]


def _rows(names: list[str], kinds: list[pa.DataType], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows in lists of about BATCH bytes; the last column has the bytes."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            rows.append(row)
            size += len(row[-1])
            if size >= BATCH:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _chained(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The eight-byte words that cover each piece, one after the other; the last ones overlap."""
    for shift in range(0, 2 * LENGTH, 8):
        yield words[at + np.minimum(shift, lengths - 8)]


class Dealer:
    """From texts to the pieces of each shard: rows (shard, spans, pack). A pack holds pieces and
    the places of each, or, where `spans` is true, spans that are known to repeat."""

    SCHEMA = "shard int, spans boolean, pack binary"

    def __init__(self, shards: int):
        self.shards = shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for texts in _gathered(batches, ["doc_id", "key", "body"]) for row in self._dealt(texts))
        yield from _rows(["shard", "spans", "pack"], [pa.int32(), pa.bool_(), pa.binary()], rows)

    def _dealt(self, texts: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        texts.sort(key=lambda t: t[0])  # the first document with a piece is the least
        groups, found, begin = [], [], 0
        for group in _stretches(texts):
            bounds = np.cumsum([0, *(len(cut) for *_, cut in group)])
            data = b"".join(cut for *_, cut in group)
            at, end, text, minimizer, anchor = _pieces(data + bytes(8), bounds[:-1], bounds[1:])
            of = np.array([g[:3] for g in group], dtype=np.int64)[text]
            found.append((at + begin, end - at, minimizer, anchor, of[:, 0], of[:, 1], of[:, 2] + at - bounds[text]))
            groups.append(data)
            begin += len(data)
        if not found:
            return
        data = b"".join([*groups, bytes(8)])
        at, lengths, minimizer, anchor, document, key, start = (np.concatenate(c) for c in zip(*found))
        first = _first_of_equals(data, at, lengths)
        known = document[first] != document
        if known.any():
            spans = np.empty(int(known.sum()), _SPANS)
            spans["document"], spans["key"], spans["start"] = document[known], key[known], start[known]
            spans["end"] = start[known] + lengths[known]
            yield int(spans["key"][0]) % self.shards, True, _packed(*_columns(spans))
        places = np.empty(int((~known).sum()), _PLACES)
        places["key"], places["start"], of_piece = key[~known], start[~known], first[~known]
        copies = np.bincount(of_piece, minlength=len(at))
        places = places[np.argsort(of_piece, kind="stable")]
        begun = np.cumsum(copies) - copies
        pieces = np.flatnonzero(copies)
        for shard, own in _bundles((mix(minimizer[pieces] * MULTIPLIERS[3]) % np.uint64(self.shards)).astype(np.int32)):
            own = pieces[own]
            numbers = np.empty(len(own), _NUMBERS)
            numbers["length"], numbers["anchor"], numbers["copies"] = lengths[own], anchor[own], copies[own]
            numbers["document"] = document[own]
            held = places[np.repeat(begun[own], copies[own]) + _counted(copies[own])]
            body = b"".join([data[a:e] for a, e in zip(at[own].tolist(), (at[own] + lengths[own]).tolist())])
            yield shard, False, _packed(*_columns(numbers), *_columns(held), body)


def _first_of_equals(data: bytes, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each piece the first one of the same bytes, found by hash and then compared."""
    words = _words(data, 8)
    hash_ = lengths.astype(np.uint64)
    for word in _chained(words, at, lengths):
        hash_ = mix(hash_ * MULTIPLIERS[1] + word)
    order = np.argsort(hash_, kind="stable")
    new = np.concatenate([[True], hash_[order][1:] != hash_[order][:-1]])
    first = np.empty(len(at), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    asked = np.flatnonzero(first != np.arange(len(at)))
    other = first[asked]
    same = lengths[asked] == lengths[other]
    for one, two in zip(_chained(words, at[asked], lengths[asked]), _chained(words, at[other], lengths[asked])):
        same &= one == two
    first[asked[~same]] = asked[~same]  # stands for itself
    return first


def _counted(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed by the bucket in which they are cut."""
    def rows() -> Iterator[tuple]:
        for texts in _gathered(batches, ["bucket", "doc_id", "key", "body"]):
            ids = np.array([(d is not None, d or 0, key, len(body)) for _, d, key, body in texts], dtype=np.int64)
            for bucket, own in _bundles(np.array([t[0] for t in texts], dtype=np.int64)):
                yield bucket, _packed(*ids[own].T, b"".join([texts[i][3] for i in own.tolist()]))

    yield from _rows(["bucket", "pack"], [pa.int64(), pa.binary()], rows())


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by Larsson and Sadakane's refinement. `ends` has, for each
    byte, where its piece ends: a suffix ends there, and of equal ones the earlier comes first."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    place, step = np.arange(n), 7
    left = np.minimum(ends - place, step).astype(np.uint64)
    padded = data.tobytes() + bytes(8)
    key = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64) >> np.uint64(8)
    cut = np.uint64(8) * (np.uint64(step) - left)
    key = ((key >> cut) << cut) << np.uint64(8) | left
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        # Only groups that are not yet alone; members that have ended come first.
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        asked, group = order[slots], start[slots]
        goes_on = ends[asked] - asked > step
        if not goes_on.any():
            break
        beyond = np.where(goes_on, rank[np.minimum(asked + step, n - 1)] + 1, 0)
        both = group << 32 | beyond
        inner = np.argsort(both)
        asked, both = asked[inner], both[inner]
        order[slots] = asked
        new[slots[1:]] |= both[1:] != both[:-1]
        start[slots] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        rank[asked] = start[slots]
        step *= 2
    order[slots] = asked[np.argsort(group << 32 | asked)]  # equal ones by place
    return order


def common_prefixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in order, by Kasai's method:
    from a suffix to the next one of its piece the prefix loses one byte at most. All pieces
    advance together."""
    n = len(data)
    ends = np.repeat(starts + lengths, lengths)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    common = np.zeros(n, np.int32)
    reached = np.zeros(len(starts), np.int64)
    pieces = np.arange(len(starts))
    for offset in range(int(lengths.max(initial=0))):
        pieces = pieces[lengths[pieces] > offset]
        at = starts[pieces] + offset
        other = before[at]
        h = np.where(other >= 0, np.maximum(reached[pieces] - 1, 0), 0)
        room = np.where(other >= 0, np.minimum(ends[at] - at, ends[other] - other), 0)
        going = np.flatnonzero(h < room)
        while len(going):
            going = going[data[at[going] + h[going]] == data[other[going] + h[going]]]
            h[going] += 1
            going = going[h[going] < room[going]]
        common[at], reached[pieces] = h, h
    return common[order]


def _shared(body: bytes, starts: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Pieces of which one half, the minimizer with REACH bytes before or behind it, is in a piece of
    another document. A string of LENGTH bytes holds one of the halves of its minimizer."""
    words = _words(body + bytes(8), 8)
    hashes, owners = [], []
    size = REACH + GRAM
    for side, begin in ((1, anchors - REACH), (2, anchors)):
        there = np.flatnonzero((begin >= 0) & (begin + size <= lengths))
        at = starts[there] + begin[there]
        h = np.full(len(at), side, dtype=np.uint64)
        for shift in (*range(0, size - 8, 8), size - 8):
            h = mix(h * MULTIPLIERS[1] + words[at + shift])
        hashes.append(h)
        owners.append(there)
    hash_, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(hash_, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], hash_[order][1:] != hash_[order][:-1]])) if len(order) else order
    kept = np.zeros(len(starts), dtype=bool)
    if len(order):
        of = documents[owner[order]]
        several = np.minimum.reduceat(of, at) < np.maximum.reduceat(of, at)
        kept[owner[order][np.repeat(several, np.diff(np.append(at, len(order))))]] = True
    return kept


class _Array:
    """One suffix array: its strings of LENGTH bytes in order, each with its least document."""

    def __init__(self, body: bytes, lengths: np.ndarray, documents: np.ndarray):
        data = np.frombuffer(body, dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        piece = np.repeat(np.arange(len(lengths)), lengths)
        ends = (starts + lengths)[piece]
        order = suffix_array(data, ends)
        common = common_prefixes(data, starts, lengths, order)
        string = np.cumsum(common < LENGTH) - 1
        whole = np.flatnonzero(ends[order] - order >= LENGTH)
        places, string = order[whole], string[whole]
        first = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
        self.string = np.cumsum(np.concatenate([[0], string[1:] != string[:-1]])).astype(np.int32)
        self.least = np.minimum.reduceat(documents[piece[places]], first)
        rows = np.ascontiguousarray(sliding_window_view(data, LENGTH)[places[first]])
        self.strings = rows.view(f"S{LENGTH}").ravel()
        self.piece = piece[places].astype(np.int32)
        self.offset = (places - starts[self.piece]).astype(np.int32)


def _found(strings: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By binary search, where strings are or would be, and which of them are there."""
    at = np.searchsorted(among, strings)
    return at, np.append(among, b"")[at] == strings if len(among) else np.zeros(len(strings), bool)


def _repeats(body: bytes, lengths: np.ndarray, documents: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, first byte, byte after the last) of what repeats a smaller document."""
    ends = np.cumsum(lengths)
    cuts = np.flatnonzero(np.diff((ends - 1) // ARRAY, prepend=-1))
    arrays = []
    strings, least = np.empty(0, f"S{LENGTH}"), np.empty(0, np.int64)
    for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lengths)]):
        one = _Array(body[ends[a] - lengths[a] : ends[e - 1]], lengths[a:e], documents[a:e])
        arrays.append((a, one))
        if len(cuts) == 1:
            strings, least = one.strings, one.least
            break
        at, there = _found(one.strings, strings)
        least[at[there]] = np.minimum(least[at[there]], one.least[there])
        strings = np.insert(strings, at[~there], one.strings[~there])
        least = np.insert(least, at[~there], one.least[~there])
    for a, one in arrays:
        at, _ = _found(one.strings, strings)
        gone = least[at][one.string] < documents[a + one.piece]
        piece, offset = a + one.piece[gone], one.offset[gone]
        order = np.lexsort((offset, piece))
        piece, offset = piece[order], offset[order]
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(piece) else piece
        last = np.append(new[1:], len(piece)) - 1 if len(piece) else piece
        yield piece[new], offset[new], offset[last] + LENGTH


class Judge:
    """Of a shard's pieces, the spans that repeat a smaller document, by bucket of their text."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, shard: pa.Table) -> pa.Table:
        numbers, places, bodies, spans = [], [], [], []
        for known, pack in zip(shard.column("spans").to_pylist(), shard.column("pack").to_pylist()):
            parts = _unpacked(pack)
            if known:
                spans.append(_records(_SPANS, parts))
                continue
            numbers.append(_records(_NUMBERS, parts))
            places.append(_records(_PLACES, parts))
            bodies.append(next(parts))
        if numbers:
            spans.extend(self._judged(np.concatenate(numbers), np.concatenate(places), b"".join(bodies)))
        found = np.concatenate(spans) if spans else np.empty(0, _SPANS)
        found = found[np.lexsort((found["start"], found["key"]))]
        packs = [(bucket, _packed(*_columns(found[own]))) for bucket, own in _bundles(found["key"] % self.buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in packs], pa.int64()), "pack": pa.array([p for _, p in packs], pa.binary())})

    def _judged(self, numbers: np.ndarray, places: np.ndarray, body: bytes) -> Iterator[np.ndarray]:
        lengths, documents = numbers["length"].astype(np.int64), numbers["document"]
        starts = np.cumsum(lengths) - lengths
        # Equal pieces of several batches become one, of the least document; the others repeat it whole.
        first = _first_of_equals(body + bytes(8), starts, lengths)
        least = documents.copy()
        np.minimum.at(least, first, documents)
        repeats = documents > least[first]
        whole = np.flatnonzero(repeats)
        yield self._spans(numbers, places, whole, np.zeros(len(whole), np.int64), lengths[whole])
        own = np.flatnonzero(first == np.arange(len(first)))
        own = own[_shared(body, starts[own], lengths[own], numbers["anchor"][own].astype(np.int64), least[own])]
        if not len(own):
            return
        kept = b"".join([body[a:e] for a, e in zip(starts[own].tolist(), (starts + lengths)[own].tolist())])
        members = np.flatnonzero(~repeats)
        members = members[np.argsort(first[members], kind="stable")]
        begin, end = (np.searchsorted(first[members], own, side) for side in ("left", "right"))
        for piece, start, stop in _repeats(kept, lengths[own], least[own]):
            copies = (end - begin)[piece]
            row = np.repeat(np.arange(len(piece)), copies)
            member = members[begin[piece][row] + _counted(copies)]
            yield self._spans(numbers, places, member, start[row], stop[row])

    @staticmethod
    def _spans(numbers: np.ndarray, places: np.ndarray, piece: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Spans of pieces, at each of their places."""
        before = np.cumsum(numbers["copies"]) - numbers["copies"]
        copies = numbers["copies"][piece].astype(np.int64)
        row = np.repeat(np.arange(len(piece)), copies)
        place = before[piece][row] + _counted(copies)
        spans = np.empty(len(row), _SPANS)
        spans["document"], spans["key"] = numbers["document"][piece][row], places["key"][place]
        spans["start"] = places["start"][place] + start[row]
        spans["end"] = places["start"][place] + stop[row]
        return spans


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    """What is left of each text of a bucket, and the spans that went."""
    spans = np.concatenate([np.empty(0, _SPANS), *(_records(_SPANS, _unpacked(p)) for p in found.column("pack").to_pylist())])
    spans = spans[np.lexsort((spans["start"], spans["document"], spans["key"]))]
    begun = np.concatenate([[True], (np.diff(spans["key"]) != 0) | (np.diff(spans["document"]) != 0)])[: len(spans)]
    at = np.flatnonzero(begun)
    of = {}
    for a, e in zip(at.tolist(), [*at[1:].tolist(), len(spans)]):
        start, reach = spans["start"][a:e], np.maximum.accumulate(spans["end"][a:e])
        new = np.concatenate([[True], start[1:] > reach[:-1]])
        last = np.append(np.flatnonzero(new)[1:], e - a) - 1
        of[spans["document"][a].item(), spans["key"][a].item()] = list(zip(start[new].tolist(), reach[last].tolist()))
    ids, sizes, kept, gone = [], [], [], []
    for pack in texts.column("pack").to_pylist():
        *numbers, bodies = _unpacked(pack)
        at = 0
        for numbered, document, key, size in zip(*(np.frombuffer(n, np.int64).tolist() for n in numbers)):
            body, at = bodies[at : at + size], at + size
            own = of.get((document, key), []) if numbered else []
            edges = [0, *(x for span in own for x in span), size]
            ids.append(document if numbered else None)
            sizes.append(size)
            kept.append(b"".join([body[a:e] for a, e in zip(edges[::2], edges[1::2])]))
            gone.append([{"start": a, "end": e} for a, e in own])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()),
                     "kept": pa.array(kept, pa.binary()), "removed": pa.array(gone, kind)})


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (bytes) and removed (spans of bytes, end exclusive) of each document.

    A byte goes if a string of LENGTH bytes that covers it begins in a document of smaller doc_id too.
    A null text is empty; texts shorter than LENGTH stay as they are. Rows of one doc_id do not take
    from each other; a row without doc_id neither loses nor takes. Repeated rows fare alike. Further
    columns are not looked at; an empty table gives no rows. Texts of any length are cut into
    stretches."""
    spark = documents.sparkSession
    whole = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body"))
    whole = whole.withColumn("key", F.xxhash64("body"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A string of bytes travels in about 70 bytes for each 20 of its text.
    shards, buckets = 1 + size * 4 // SHARD, 1 + size // BUCKET
    known = whole.filter(F.col("doc_id").isNotNull() & (F.length("body") >= LENGTH))
    pieces = known.select("doc_id", "key", "body").mapInArrow(Dealer(shards), Dealer.SCHEMA)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    judge = Judge(buckets)
    dealt = pieces.repartition(min(shards, tasks), "shard").groupBy("shard")
    judged = dealt.applyInArrow(lambda shard: judge(shard), "bucket bigint, pack binary")
    placed = whole.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("bigint")).select("bucket", "doc_id", "key", "body")
    texts = placed.mapInArrow(_bundled, "bucket bigint, pack binary")
    schema = "doc_id bigint, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>"
    return texts.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(lambda own, found: _cut(own, found), schema)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(documents).select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))

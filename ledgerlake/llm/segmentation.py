"""SentencePiece segmentations sampled without replacement by Gumbel top-k."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import GOLDEN, mix, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SPACE = "▁"
MARK = "\ud800"  # stands for a literal SPACE; no text holds a lone surrogate
FIRST_BYTE, FIRST_PIECE = 3, 259  # ids of <0x00> and of the first piece that is no control or byte
BYTE_LOSS = 3.0  # a byte is so much (natural log) less likely than the rarest piece
LONGEST = 16  # characters in the longest piece
CODES = 1 << 21  # more than there are code points
STORED = 1_500_000  # edges of lattices that are remembered
TOGETHER = 200_000  # characters of texts that are drawn at once; a longer text is drawn alone
DRAWS = 999_983  # tells a row's further random numbers from those of its walks
CUT = "\udfff"  # stands between chunks; another lone surrogate
BLANKS = SPACE + CUT + SPACE
EDGE_KINDS = (("reached", np.float64), ("to", np.int32), ("id", np.int32), ("log", np.float64))


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces by id. Read once, by the driver; its size is that of the vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def _longer(column: np.ndarray, more: int) -> np.ndarray:
    """The same values with undefined ones behind them."""
    room, size = column if column.base is None else column.base, len(column) + more
    if len(room) < size:
        room = np.empty(size + size // 2, dtype=column.dtype)
        room[: len(column)] = column
    return room[:size]


class Lattices:
    """Lattices of chunks, side by side in arrays. No piece reaches over the end of a chunk (a
    piece has SPACE at its beginning only, and none has a line break), so the lattice of a
    text is that of its chunks, one after another.

    Piece probabilities follow Zipf's law by id, as the vocabulary is in order of merging. An
    edge carries its conditional probability given its node: piece times all ways on, divided
    by all ways from the node. A walk by these draws a segmentation by its probability.

    The edges of node k are those from begin[k] to begin[k + 1]. `reached` is the running sum
    of their probabilities within the node, `to` the next node, or -1 at the end of a chunk."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        total = math.fsum(1 / (i - FIRST_PIECE + 2) for i in range(FIRST_PIECE, len(pieces)))
        logs = [-math.log((i - FIRST_PIECE + 2) * total) for i in range(FIRST_PIECE, len(pieces))]
        self.byte = min(logs) - BYTE_LOSS
        # Every beginning of a piece is a state; one more character leads to another state.
        states = {"": 0}
        for piece in pieces[FIRST_PIECE:]:
            for n in range(1, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        step = np.array([states[p[:-1]] * CODES + ord(p[-1]) for p in states if p], dtype=np.int64)
        self._file(step, np.arange(1, len(states)))
        self.id_of, self.log_of = np.full(len(states), -1, dtype=np.int32), np.zeros(len(states))
        for i, (piece, log) in enumerate(zip(pieces[FIRST_PIECE:], logs), FIRST_PIECE):
            self.id_of[states[piece]], self.log_of[states[piece]] = i, log
        self.forget()

    def _file(self, step: np.ndarray, after: np.ndarray) -> None:
        """A hash table of the steps, at least four places for each. A taken place passes on to the next."""
        bits = (4 * len(step)).bit_length()
        self.shift, size = np.uint64(64 - bits), (1 << bits) + len(step)
        self.step, self.after = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        place = self._place(step)
        while len(step):
            free = self.step[place] < 0
            self.step[place[free]] = step[free]
            here = self.step[place] == step
            self.after[place[here]] = after[here]
            step, after, place = step[~here], after[~here], place[~here] + 1

    def _place(self, step: np.ndarray) -> np.ndarray:
        return ((step.view(np.uint64) * GOLDEN) >> self.shift).view(np.int64)

    def _next(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a step by their character, and the states it leads to."""
        step = state * CODES + codes
        place = self._place(step)
        there = self.step[place]
        late = np.flatnonzero((there != step) & (there >= 0))
        while len(late):
            place[late] += 1
            there[late] = self.step[place[late]]
            late = late[(there[late] != step[late]) & (there[late] >= 0)]
        going = np.flatnonzero(there == step)
        return going, self.after[place[going]]

    def forget(self) -> None:
        self.start: dict[str, int] = {}
        self.begin = np.zeros(1, dtype=np.int64)
        self.edges = {name: np.empty(0, dtype=kind) for name, kind in EDGE_KINDS}

    def _grow(self, nodes: int, edges: int) -> None:
        """Lengthen the arrays. Each is a view of one with room, so that few calls copy it."""
        self.begin = _longer(self.begin, nodes)
        for name, column in self.edges.items():
            self.edges[name] = _longer(column, edges)

    def nodes(self, chunks: list[str]) -> np.ndarray:
        """The first node of each chunk's lattice."""
        first = np.fromiter(map(self.start.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        places = np.flatnonzero(first < 0)
        if len(places):
            fresh = [chunks[k] for k in places.tolist()]
            self._build(list(dict.fromkeys(fresh)))
            first[places] = np.fromiter(map(self.start.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return first

    def _pieces_at(self, codes: np.ndarray, left: np.ndarray) -> list[tuple]:
        """(positions, length, ids, logs) of the pieces at each position of some chunks; `left`
        is how many characters its chunk has from there. Lengths ascend."""
        at, state, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        for length in range(1, LONGEST + 1):
            going, state = self._next(state, codes[at + length - 1])
            at = at[going]
            ids = self.id_of[state]
            whole = np.flatnonzero(ids >= 0)
            found.append((at[whole], length, ids[whole], self.log_of[state[whole]]))
            if length == 1:  # a character that is no piece: its bytes
                odd = np.ones(len(codes), dtype=bool)
                odd[at[whole]] = False
                odd = np.flatnonzero(odd)
                code = np.where(codes[odd] == ord(MARK), ord(SPACE), codes[odd])
                size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                found.append((odd, 1, np.where(size == 1, FIRST_BYTE + code, len(self.pieces) + code), self.byte * size))
            more = left[at] > length
            at, state = at[more], state[more]
            if not len(at):
                break
        return found

    def _build(self, chunks: list[str]) -> None:
        """Add the lattices of these chunks. Nodes are numbered by their distance from the
        chunk's end, so those of all chunks that are equally far are weighed at once."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        number = np.empty(len(codes), dtype=np.int64)
        small = left.astype(np.uint16) if sizes.max() < 1 << 16 else left  # sorted by radix
        number[np.argsort(small, kind="stable")] = np.arange(len(codes))
        found = [(number[at], at, length, ids, logs) for at, length, ids, logs in self._pieces_at(codes, left)]

        counts = np.zeros(len(codes), dtype=np.int64)
        for node, *_ in found:
            counts[node] += 1
        begin = np.concatenate([[0], np.cumsum(counts)])
        free = begin[:-1].copy()
        to, ids, ways = np.empty(begin[-1], dtype=np.int32), np.empty(begin[-1], dtype=np.int32), np.empty(begin[-1])
        for node, at, length, own, logs in found:
            place = free[node]
            free[node] = place + 1
            to[place] = np.where(left[at] > length, number[np.minimum(at + length, len(codes) - 1)], -1)
            ids[place], ways[place] = own, logs

        back = np.zeros(len(codes) + 1)  # log of all ways from a node to the end; the last is the end itself
        level = np.concatenate([[0], np.cumsum(np.bincount(left)[1:])]).tolist()
        for one, other in zip(level[:-1], level[1:]):
            here = slice(begin[one], begin[other])
            ways[here] += back[to[here]]
            first = begin[one:other] - begin[one]
            top = np.maximum.reduceat(ways[here], first)
            spread = np.exp(ways[here] - np.repeat(top, counts[one:other]))
            back[one:other] = top + np.log(np.add.reduceat(spread, first))

        logs = ways - np.repeat(back[:-1], counts)
        before = np.concatenate([[0.0], np.cumsum(np.exp(logs))])
        reached = np.minimum(before[1:] - np.repeat(before[begin[:-1]], counts), 1 - 1e-12)
        reached[begin[1:] - 1] = 1.0
        nodes, edges = len(self.begin) - 1, len(self.edges["to"])
        new = {"reached": reached, "to": np.where(to < 0, -1, to + nodes), "id": ids, "log": np.minimum(logs, 0.0)}
        self._grow(len(codes), len(to))
        self.begin[nodes + 1 :] = begin[1:] + edges
        for name, column in new.items():
            self.edges[name][edges:] = column
        self.start.update(zip(chunks, (nodes + number[ends - sizes]).tolist()))

    def picked(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that holds a number in (0, 1)."""
        reached = self.edges["reached"]
        edge = self.begin[nodes]
        late = np.flatnonzero(reached[edge] <= u)
        on, u = edge[late], u[late]
        while len(late):
            on += 1
            edge[late] = on
            more = np.flatnonzero(reached[on] <= u)
            late, on, u = late[more], on[more], u[more]
        return edge

    def picked_one(self, node: int, u: float) -> int:
        reached, edge = self.edges["reached"], int(self.begin[node])
        while reached[edge] <= u:
            edge += 1
        return edge

    def siblings(self, edge: int) -> np.ndarray:
        """All edges of the node that an edge leaves."""
        node = int(np.searchsorted(self.begin, edge, side="right")) - 1
        return np.arange(self.begin[node], self.begin[node + 1])


def _uniform(seed: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    """Numbers in (0, 1), the same for the same seed and counters on any machine."""
    return _drawn(mix(seed + a.astype(np.uint64) * GOLDEN), b)


def _drawn(mixed: np.ndarray, b: int) -> np.ndarray:
    """_uniform() of what its seeds and first counters were mixed to."""
    drawn = mix(mixed + np.uint64((b + 1) * int(GOLDEN) % 2**64))
    return ((drawn >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _walk(lattices: Lattices, starts: np.ndarray, seeds: np.ndarray, counters: np.ndarray, sample: int):
    """A random walk through each chunk: the edges, and where each chunk's edges begin."""
    to = lattices.edges["to"]
    going, at, taken, step = np.arange(len(starts)), starts, [], 0
    mixed = mix(seeds + counters.astype(np.uint64) * GOLDEN)
    counts = np.empty(len(starts), dtype=np.int64)
    while len(going):
        edge = lattices.picked(at, _drawn(mixed, sample * 1_000_003 + step))
        taken.append((going, edge))
        at, step = to[edge], step + 1
        counts[going] = step
        on = np.flatnonzero(at >= 0)
        going, at, mixed = going[on], at[on], mixed[on]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    edges = np.empty(bounds[-1], dtype=np.int64)
    for step, (who, edge) in enumerate(taken):
        edges[bounds[who] + step] = edge
    return edges, bounds


_ALL = 2**64 - 1


def _mixed(x: int) -> int:
    """mix() of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


class _Row:
    """One text on its way: what was drawn, its queue, and how many random numbers it took."""

    def __init__(self, seed: int, path: np.ndarray):
        self.seed, self.taken = seed, 0
        self.queue: list = []
        self.out = [path]
        self.time = -math.log(self.draw())

    def draw(self) -> float:
        """The next number in (0, 1); as _uniform() gives."""
        drawn = _mixed(_mixed(self.seed + self.taken * int(GOLDEN) & _ALL) + (DRAWS + 1) * int(GOLDEN) & _ALL)
        self.taken += 1
        return ((drawn >> 12) + 0.5) * 2.0**-52


def _leave(lattices: Lattices, rows: list[_Row], since: list[int], samples: int) -> None:
    """Queue the side branches of each row's newest path from a position on; only the soonest
    of a path can ever be wanted. The branches of all rows are weighed at once."""
    paths = [row.out[-1] for row in rows]
    sizes = np.array([max(0, len(p) - s) for p, s in zip(paths, since)], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not bounds[-1]:
        return
    own, before = np.empty(bounds[-1]), np.empty(bounds[-1])
    for k, (path, start) in enumerate(zip(paths, since)):
        logs = lattices.edges["log"][path]
        own[bounds[k] : bounds[k + 1]] = logs[start:]
        before[bounds[k] : bounds[k + 1]] = (np.cumsum(logs) - logs)[start:]
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    seeds = np.repeat(np.array([row.seed for row in rows], dtype=np.uint64), sizes)
    u = _uniform(seeds, place + np.repeat([row.taken for row in rows], sizes), DRAWS)
    with np.errstate(divide="ignore", over="ignore"):
        gaps = np.exp(np.log(-np.log(u)) - (before + np.log1p(-np.exp(own))))
    times = np.repeat([row.time for row in rows], sizes) + gaps
    for k, (row, path, start) in enumerate(zip(rows, paths, since)):
        here = times[bounds[k] : bounds[k + 1]]
        row.taken += len(here)
        few = min(samples, len(here))
        for s in np.argpartition(here, few - 1)[:few].tolist() if few else ():
            if math.isfinite(here[s]):
                heapq.heappush(row.queue, (float(here[s]), len(row.out) - 1, start + s, (int(path[start + s]),), len(row.queue), path))


def _branch(lattices: Lattices, row: _Row) -> tuple[np.ndarray, int, int]:
    """Take the next arrival off a row's queue: the new path up to the end of the chunk where
    it leaves its parent, where it does, and how many chunks it has so far."""
    log, to = lattices.edges["log"], lattices.edges["to"]
    row.time, _, at, excluded, _, parent = heapq.heappop(row.queue)
    others = np.array([e for e in lattices.siblings(excluded[0]).tolist() if e not in excluded])
    weight = np.exp(log[others])
    reached = np.cumsum(weight)
    chosen = min(int(np.searchsorted(reached, row.draw() * reached[-1])), len(others) - 1)
    edge = int(others[chosen])
    tail = [edge]
    while (node := int(to[tail[-1]])) >= 0:
        tail.append(lattices.picked_one(node, row.draw()))
    left = weight.sum() - weight[chosen]
    if len(others) > 1 and left > 0:
        rate = float(log[parent[:at]].sum()) + math.log(left)
        gap = math.log(-math.log(row.draw())) - rate
        if gap < 700:
            heapq.heappush(row.queue, (row.time + math.exp(gap), len(row.out), at, (*excluded, edge), len(row.queue), parent))
    path = np.concatenate([parent[:at], tail]).astype(np.int64)
    return path, at, int(np.count_nonzero(to[path] < 0))


def _scored(lattices: Lattices, row: _Row) -> list[tuple]:
    """Each path of a row with its log probability and that of its inclusion. The queue's next
    time, beyond the last sample, is the threshold."""
    limit = math.log(row.queue[0][0]) if row.queue else math.inf
    scored = []
    for path in row.out:
        total = float(lattices.edges["log"][path].sum())
        reach = total + limit
        scored.append((path, total, 0.0 if reach > 3 else math.log(-math.expm1(-math.exp(reach))) if reach > -30 else reach))
    return scored


def chunks(text: str) -> list[str]:
    """Line breaks, and the words between them, each with the blanks that stand before it."""
    if not text:
        return []
    cut = (SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)).replace(SPACE, CUT + SPACE)
    while BLANKS in cut:  # halves the cuts in a run of blanks
        cut = cut.replace(BLANKS, SPACE + SPACE)
    return list(filter(None, cut.replace("\n", f"{CUT}\n{CUT}").split(CUT)))


def together(texts: Sequence[str]) -> Iterator[slice]:
    """Runs of texts that have at most TOGETHER characters, or are one text."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > TOGETHER:
            yield slice(first, k)
            first, size = k, 0
        size += len(text)
    if len(texts):
        yield slice(first, len(texts))


def sampled(lattices: Lattices, texts: Sequence[str], keys: np.ndarray, samples: int) -> list[list[tuple]]:
    """Per text its (ids, log probability, log inclusion probability), best first; `keys`
    are the rows' 64-bit seeds. An empty text has one segmentation, of no piece.

    A* over subtrees of the lattice's paths: the Gumbel of a subtree's best path is -ln of the
    arrival time of a Poisson process whose rate is the subtree's probability, so a row's queue
    holds arrival times, least first. When a path arrives, every node on it leaves behind the
    subtree of its other edges, whose next arrival is later by an exponential time of its own
    rate. All rows of a batch take one sample at a time, each of them walking only the chunks
    behind the one where it leaves its parent."""
    if len(lattices.edges["to"]) > STORED:
        lattices.forget()
    split = [chunks(t) for t in texts]
    starts = lattices.nodes([c for s in split for c in s])
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    seeds = np.repeat(keys, sizes)
    counters = np.arange(len(starts)) - np.repeat(begins[:-1], sizes)
    edges, bounds = _walk(lattices, starts, seeds, counters, 0)
    rows = {k: _Row(int(keys[k]), edges[bounds[begins[k]] : bounds[begins[k + 1]]]) for k in np.flatnonzero(sizes).tolist()}
    _leave(lattices, list(rows.values()), [0] * len(rows), samples)
    for r in range(1, samples):
        open_rows = [k for k, row in rows.items() if row.queue]
        branches = [_branch(lattices, rows[k]) for k in open_rows]
        further = [np.arange(begins[k] + done, begins[k + 1]) for k, (_, _, done) in zip(open_rows, branches)]
        those = np.concatenate([np.empty(0, dtype=np.int64), *further])
        edges, bounds = _walk(lattices, starts[those], seeds[those], counters[those], r)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in further])]).astype(np.int64)
        for k, (path, _, _), one, other in zip(open_rows, branches, ends[:-1], ends[1:]):
            rows[k].out.append(np.concatenate([path, edges[bounds[one] : bounds[other]]]))
        _leave(lattices, [rows[k] for k in open_rows], [at + 1 for _, at, _ in branches], samples)
    empty = [(np.empty(0, dtype=np.int64), 0.0, 0.0)]
    return [
        [(_ids(lattices, path), *numbers) for path, *numbers in _scored(lattices, rows[k])] if k in rows else empty
        for k in range(len(texts))
    ]


def _ids(lattices: Lattices, path: np.ndarray) -> np.ndarray:
    """The ids of a path's pieces; a character that is no piece gives those of its bytes."""
    ids, size = lattices.edges["id"][path], len(lattices.pieces)
    if ids.max(initial=0) < size:
        return ids
    flat: list[int] = []
    for i in ids.tolist():
        flat.extend([i] if i < size else [FIRST_BYTE + b for b in chr(i - size).encode()])
    return np.array(flat, dtype=np.int64)


def decoded(pieces: list[str], ids: Sequence[int]) -> str:
    """The text of a segmentation; exactly what was encoded."""
    raw = b"".join(
        bytes([i - FIRST_BYTE]) if FIRST_BYTE <= i < FIRST_BYTE + 256 else pieces[i].replace(SPACE, " ").encode()
        for i in ids
    )
    return raw.decode()[1:]


_LATTICES: list[Lattices] = []


def _kept(pieces: list[str]) -> Lattices:
    """The lattices that this worker built for its last task, if of the same vocabulary."""
    if not _LATTICES or _LATTICES[0].pieces != pieces:
        _LATTICES[:] = [Lattices(pieces)]
    return _LATTICES[0]


def segmentations(
    docs: DataFrame, pieces: list[str], samples: int = SAMPLES, seed: int = 0, key: str = "doc_id"
) -> DataFrame:
    """doc_id, rank (1 is best), ids, n_pieces, log_prob, log_inclusion: up to `samples` rows per
    row, all different, fewer where a text has fewer segmentations.

    The draws depend on the row's key, the seed and the text alone, so a repeated row or task
    gives the same again. A null key draws by the text. Null and empty texts have one empty
    segmentation. Whole texts are encoded, a very long one in its row's task, in memory in
    proportion to it, short ones some TOGETHER; repeated rows are drawn alike; other columns
    are ignored."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 250)
    shared = spark.sparkContext.broadcast(pieces)
    row_key = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col("text")), F.lit(seed))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key.alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _kept(shared.value)
        for part in parts:
            keys = part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            texts, numbers = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            for here in together(texts):
                found = sampled(lattices, texts[here], keys[here], samples)
                ids = [np.asarray(s[0], dtype=np.int32) for own in found for s in own]
                bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                doc_ids = [d for d, own in zip(numbers[here], found) for _ in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()),
                     pa.array([r + 1 for own in found for r in range(len(own))], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids), pa.int32())),
                     pa.array([len(i) for i in ids], pa.int32()),
                     pa.array([s[1] for own in found for s in own], pa.float64()),
                     pa.array([s[2] for own in found for s in own], pa.float64())],
                    names=["doc_id", "rank", "ids", "n_pieces", "log_prob", "log_inclusion"],
                )

    return rows.mapInArrow(
        draw, "doc_id long, rank int, ids array<int>, n_pieces int, log_prob double, log_inclusion double"
    )

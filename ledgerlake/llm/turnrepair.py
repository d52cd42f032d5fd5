"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation should read s?(ua)+ or be empty. The cheapest edits of its turns are found by a
dynamic program over four states (nothing yet, after system, after user, after assistant) whose
cost vectors run from the last turn to the first. Turns are cut into chunks of at most CHUNK. A chunk
starts from every cost vector there can be; vectors that differ only by a constant are one, and
there are few. Where all starts end in one vector, a chunk has converged and needs nobody. Fix-up
passes link the rest to the chunk after them, twice as far in each pass, until none is open.
The costs so stitched give, for each entry state, the state a chunk leaves in; the same
passes, forwards, tell each chunk its entry state, and it traces its least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable

CHUNK_BITS = 8  # chunks of at most 2**CHUNK_BITS turns
PREFIX = 64  # characters of role and text by which equal turns are dealt out

# Costs of the edits, and the states' successors by the initial of a role.
COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
UNFINISHED = 3  # added when a truncated turn is not deleted
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
DUE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}  # what an inserted or rerolled turn becomes
STATES = 4
FAR = 10**6

# A turn is written as one character: that of its role (o: any other), a capital if truncated, or
# its fault if it must go.
BLANK, DUPLICATE = "b", "d"
CODES = "suaoSUAO" + BLANK + DUPLICATE

Vector = tuple[int, ...]


def _closed(costs: list[int]) -> Vector:
    """With inserted turns allowed before the next one."""
    for _ in range(STATES - 1):
        costs = [min(c, COSTS["I"] + costs[DUE[q][1]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _choices(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn as (edit, cost, state after), by initial."""
    if code in (BLANK, DUPLICATE):
        return [("D", COSTS["D"], state)]
    left = UNFINISHED if code.isupper() else 0
    kept = FOLLOWS.get((state, code.lower()))
    return [
        ("D", COSTS["D"], state),
        *([("K", left, kept)] if kept is not None else []),
        ("R", COSTS["R"] + left, DUE[state][1]),
    ]


def _before(code: str, after: Vector) -> tuple[Vector, int]:
    """The cost vector in front of a turn, less its least cost, and that cost."""
    costs = _closed([min(cost + after[to] for _, cost, to in _choices(code, q)) for q in range(STATES)])
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def _vectors() -> list[Vector]:
    """All cost vectors there can be, but for constants; the first is that of the end."""
    found = [_closed([0, FAR, FAR, 0])]
    for vector in found:
        for code in CODES:
            before, _ = _before(code, vector)
            if before not in found:
                found.append(before)
    return found


@cache
def _steps() -> dict[str, bytes]:
    """For each code, the number of the vector before a turn by that of the vector after it."""
    number = {v: k for k, v in enumerate(_vectors())}
    return {c: bytes(number[_before(c, v)[0]] for v in number) + bytes(256 - len(number)) for c in CODES}


@cache
def _trace(code: str, after: int, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to and with a turn, and the state they lead to."""
    vector = _vectors()[after]
    before, least = _before(code, vector)
    edits = ""
    while True:
        exact = {e: to for e, cost, to in _choices(code, state) if cost + vector[to] == before[state] + least}
        inserted = DUE[state][1]
        if before[inserted] + COSTS["I"] == before[state]:
            exact["I"] = inserted
        edit = min(exact)
        edits, state = edits + edit, exact[edit]
        if edit != "I":
            return edits, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the checksum of `conv_id:turn`; nulls are one space,
    but null ids and turns stay null."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(written("text"), "[.!?]", "")).otherwise(written("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(written("role"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"), times.alias("times"))
    return turns.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")


def _laid_out(turns: DataFrame) -> DataFrame:
    """The turns with `place`, a number in the order of their conversation. They are dealt out by
    ranges of conversation, turn, role and text; equal turns, which have no order, also by a number
    of their row, so that neither a conversation nor copies of a turn are one task's. Very long
    texts are dealt out by their beginning and a digest."""
    head = lambda c: F.substring(c, 1, PREFIX)
    order = ["conv_id", "turn", head("role"), head("text"), "mark", "row"]
    mark = F.unhex(F.md5(F.concat_ws("\0", "role", "text").cast("binary")))
    marked = turns.withColumns({"mark": mark, "row": F.monotonically_increasing_id() % 1024})
    inked = r"[^\x20\x09-\x0D]"
    last = F.regexp_extract("text", rf"({inked})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    code = (
        F.when(~F.col("text").rlike(inked), F.lit(BLANK))
        .otherwise(F.when(last.isin(".", "!", "?"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
                   .otherwise(F.when(initial.isin("s", "u", "a"), F.upper(initial)).otherwise("O")))
    )
    laid = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(laid.select("conv_id", "turn", "role", "text", "mark", F.monotonically_increasing_id().alias("place"), code.alias("code")))


def _chunks(laid: DataFrame) -> DataFrame:
    """A row for each chunk: conv_id, at (place of its first turn), part, codes. A turn whose role
    and text came earlier is a duplicate; only keys and digests move for that."""
    firsts = laid.groupBy("conv_id", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    turns = laid.select("conv_id", "place", "code").join(firsts, "place", "left")
    code = F.when((F.col("code") != BLANK) & F.col("is_first").isNull(), F.lit(DUPLICATE)).otherwise(F.col("code"))
    gathered = turns.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("place", code.alias("code")))).alias("turns"), F.min("place").alias("at"))
    return gathered.select(
        "conv_id", "at", F.shiftright("at", 33).alias("part"), F.array_join("turns.code", "").alias("codes"))


def _linked(chunks: DataFrame) -> DataFrame:
    """With the chunk before and after of the same conversation. A conversation has a window row for
    each task that its turns are laid out in, not for each chunk."""
    inside = W.partitionBy("conv_id", "part").orderBy("at")
    across = W.partitionBy("conv_id").orderBy("part")
    spans = chunks.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spans = spans.select(
        "first", "last", F.lag("last").over(across).alias("part_before"), F.lead("first").over(across).alias("part_after"))
    numbered = chunks.select("*", F.lag("at").over(inside).alias("before"), F.lead("at").over(inside).alias("after"))
    ends = spans.select(F.col("first").alias("at"), "part_before")
    begins = spans.select(F.col("last").alias("at"), "part_after")
    return numbered.join(ends, "at", "left").join(begins, "at", "left").select(
        "conv_id", "at", "codes",
        F.coalesce("before", "part_before").alias("before"), F.coalesce("after", "part_after").alias("after"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs each chunk from its last turn to its first, from every vector at once."""
    size = len(_vectors())
    for batch in batches:
        tables = []
        for codes in batch.column("codes").to_pylist():
            vectors = bytes(range(size))
            for code in reversed(codes):
                vectors = vectors.translate(_steps()[code])
            tables.append(list(vectors))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(tables, pa.list_(pa.int32()))], names=[*batch.schema.names, "table"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each chunk leaves in, by entry state, given the vector after it."""
    for batch in batches:
        tables = []
        for codes, vector in zip(batch.column("codes").to_pylist(), batch.column("vector").to_pylist()):
            tables.append([_audit(codes, vector, q, False)[1] for q in range(STATES)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(tables, pa.list_(pa.int32()))], names=[*batch.schema.names, "table"])


def _audit(codes: str, vector: int, state: int, ends: bool) -> tuple[str, int]:
    """Edits of a chunk entered in a state, and the state it leaves in; `ends` if nothing follows."""
    vectors, edits = [vector], []
    for code in reversed(codes[1:]):
        vectors.append(_steps()[code][vectors[-1]])
    for code, after in zip(codes, reversed(vectors)):
        found, state = _trace(code, after, state)
        edits.append(found)
    while ends and state not in (0, 3):
        edits.append("I")
        state = DUE[state][1]
    return "".join(edits), state


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("codes", "vector", "state", "after"))
        audits = [_audit(codes, vector, state, after is None)[0] for codes, vector, state, after in zip(*columns)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "at", "codes", "state")), pa.array(audits, pa.string())],
            names=["conv_id", "at", "codes", "state", "audit"])


def _stitched(chunks: DataFrame, towards: str, outermost: int) -> DataFrame:
    """at -> the value that comes to each chunk from its neighbour, where `table` gives what a chunk
    passes on for each value and `outermost` comes to those without a neighbour. In each pass a chunk
    is put together with the one its link leads to, so links reach twice as far; a chunk whose table
    is constant has converged and needs no link."""
    alone = F.array_repeat(F.element_at("table", outermost + 1), F.size("table"))
    constant = F.size(F.array_distinct("table")) == 1
    links = chunks.select("at", F.col(towards).alias("link"), F.when(F.col(towards).isNull(), alone).otherwise(F.col("table")).alias("table"))
    links = durable(links.withColumn("link", F.when(~constant, F.col("link"))))
    while not links.filter(F.col("link").isNotNull()).isEmpty():
        there = links.select(F.col("at").alias("link"), F.col("link").alias("further"), F.col("table").alias("theirs"))
        joined = F.transform("theirs", lambda v: F.element_at("table", v + 1))
        passed = links.filter(F.col("link").isNotNull()).join(there, "link").select("at", F.col("further").alias("link"), joined.alias("table"))
        passed = passed.withColumn("link", F.when(~constant, F.col("link")))
        links = durable(links.filter(F.col("link").isNull()).union(passed))
    out = links.select(F.col("at").alias(towards), F.element_at("table", 1).alias("value"))
    return chunks.select("at", towards).join(out, towards, "left").select("at", F.coalesce("value", F.lit(outermost)).alias("value"))


def audits(laid: DataFrame) -> DataFrame:
    """conv_id, at, codes, state (on entry) and audit of each chunk of turns laid out."""
    kind = laid.schema["conv_id"].dataType.simpleString()
    chunks = durable(_linked(durable(_chunks(laid))))
    names = ["conv_id", "at", "codes", "before", "after"]
    base = f"conv_id {kind}, at bigint, codes string, before bigint, after bigint"
    swept = durable(chunks.select(names).mapInArrow(_swept, f"{base}, table array<int>"))
    vectors = _stitched(swept, "after", 0).withColumnRenamed("value", "vector")
    costed = swept.join(vectors, "at").select(*names, "vector")
    traced = durable(costed.mapInArrow(_traced, f"{base}, vector int, table array<int>"))
    states = _stitched(traced, "before", 0).withColumnRenamed("value", "state")
    entered = traced.join(states, "at").select(*names, "vector", "state")
    return entered.mapInArrow(_audited, f"conv_id {kind}, at bigint, codes string, state int, audit string")


def edited(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, in order: conv_id, step, turn, was (role before),
    fault (blank, duplicate, truncated or null), edit, role and text after it.

    An inserted row has null turn and was; a deleted one has null role and text. Turns of one number
    stand by role, then by text (by their first 64 characters, and beyond by digest); those without
    a number come first. Rows of a conversation stand together and in order in the frame given back,
    as the text of one has to be read from its beginning. They are streamed through a task, never
    held. Nulls in role or text are one space. A null conv_id is a conversation of its own."""
    filled = turns.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    laid = _laid_out(filled)
    rows = laid.select("conv_id", "place", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("int").alias("state"))
    chunks = audits(laid).select(
        "conv_id", F.col("at").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(laid.schema["turn"].dataType).alias("turn"),
        F.col("audit").alias("role"), F.col("codes").alias("text"), "state")
    together = rows.union(chunks).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema}
    return together.mapInArrow(
        _replayed, f"conv_id {kinds['conv_id']}, step bigint, turn {kinds['turn']}, was string, fault string, "
        "edit string, role string, text string")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    faults = {BLANK: "blank", DUPLICATE: "duplicate"}
    no_conversation = object()
    conversation, step, state, audit, codes = no_conversation, 0, 0, iter(""), iter("")
    for batch in batches:
        kinds = {f.name: f.type for f in batch.schema}
        out: list[tuple] = []
        for conv, _, kind, turn, role, text, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != conversation:
                conversation, step = conv, 0
            if kind == 0:
                audit, codes, state = iter(role), iter(text), entry
                # Inserts at the very end follow the last turn.
                tail, turns_left = len(role) - len(role.rstrip("I")), len(text)
                continue
            code = next(codes)
            fault = faults.get(code) or ("truncated" if code.isupper() else None)
            turns_left -= 1
            while (edit := next(audit)) == "I":
                due, state = DUE[state]
                out.append((conv, step, None, None, None, "I", due, ""))
                step += 1
            if edit == "D":
                out.append((conv, step, turn, role, fault, "D", None, None))
            elif edit == "K":
                state = FOLLOWS[state, code.lower()]
                out.append((conv, step, turn, role, fault, "K", role, text))
            else:
                due, state = DUE[state]
                out.append((conv, step, turn, role, fault, "R", due, text))
            step += 1
            if not turns_left:
                for _ in range(tail):
                    due, state = DUE[state]
                    out.append((conv, step, None, None, None, "I", due, ""))
                    step += 1
        columns = list(zip(*out)) or [()] * 8
        types = [kinds["conv_id"], pa.int64(), kinds["turn"], *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["conv_id", "step", "turn", "was", "fault", "edit", "role", "text"])


class _Sum:
    """What is reported of one conversation, built up row by row."""

    def __init__(self, conv_id: object):
        self.conv_id, self.faults = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.initial = None
        self.audit: list[str] = []
        self.text, self.lines = hashlib.sha256(), 0

    def add(self, turn: int | None, was: str | None, fault: str | None, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += COSTS[edit] + (UNFINISHED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and turn != self.most:  # turns come in order
                self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if edit != "D":
            self.text.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.text.hexdigest())


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: _Sum | None = None
    kind = None

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (1 + len(_REPORT))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *_REPORT])

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        names = ("conv_id", "turn", "was", "fault", "edit", "role", "text")
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if open_ is None or open_.conv_id != conv:
                if open_ is not None:
                    done.append(open_.row())
                open_ = _Sum(conv)
            open_.add(*row)
        yield given(done)
    if open_ is not None:
        yield given([open_.row()])


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id there was before damage: gaps, blank, duplicate, truncated, illegal, cost,
    audit and the digest of the repaired turns. A conversation without turns left has zeros, an empty
    audit and the digest of nothing; further columns are not looked at; an empty table gives no rows."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} {'bigint' if k < 6 else 'string'}" for k, c in enumerate(_REPORT))
    found = durable(edited(damaged(conversations)).mapInArrow(_summed, schema))
    every = conversations.select(F.col("conv_id").alias("every")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    filled: list[Column] = [F.coalesce(F.col(c), F.lit(nothing.get(c, 0))).alias(c) for c in _REPORT]
    return every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(F.col("every").alias("conv_id"), *filled)

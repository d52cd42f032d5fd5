"""Near copies by SuperMinHash: signatures, banding, verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import (
    GOLDEN, durable, mix, shingle_sets, small_batches, text_bytes, text_key,
)

SLOTS = 128  # values in a signature
FEW = 6  # levels after which each element's order is kept as an array
MISS = 1e-7  # a pair right at the threshold may share no band with this probability
SAMPLED = 32  # texts of a group that all its texts are compared with
BLOCK = 512  # texts of a group that are compared in one go


def rows_per_band(percent: int, slots: int = SLOTS, miss: float = MISS) -> int:
    """The longest bands that still lose a pair at the threshold with at most `miss`."""
    t = percent / 100
    return max((r for r in range(1, slots + 1) if (1 - t**r) ** (slots // r) <= miss), default=1)


def signatures(sets: Sequence[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of some sets of 64-bit hashes, a row each. Each element visits the slots
    in a random order of its own (a Fisher-Yates shuffle, one swap per level) and offers
    level + u to the slot it visits; a slot keeps its least offer. An offer of a later level
    is never less, so a set is done at the level that fills its last slot."""
    least = np.full((len(sets), slots), np.inf)
    elements = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    picks, order = [], None
    for level in range(slots):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((level + 1) * int(GOLDEN) % 2**64))
        offer = level + (draw >> np.uint64(11)) * 2.0**-53
        pick = level + ((mix(draw) >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level < FEW:  # follow the swaps back instead of keeping every order
            slot = pick.copy()
            for k in range(level - 1, -1, -1):
                slot[picks[k] == slot] = k
            picks.append(pick)
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                for k, earlier in enumerate(picks):
                    _swap(order, k, earlier)
            slot = _swap(order, level, pick)
        np.minimum.at(least.reshape(-1), owner * slots + slot, offer)
        still = np.unique(owner)
        unfilled = np.zeros(len(sets), dtype=bool)
        unfilled[still] = least[still].max(axis=1) >= slots
        going = unfilled[owner]
        if not going.all():
            elements, owner = elements[going], owner[going]
            picks = [p[going] for p in picks] if order is None else []
            order = None if order is None else order[going]
    return least


def _swap(order: np.ndarray, level: int, pick: np.ndarray) -> np.ndarray:
    """The slots at `pick`; they go to `level`, and what stood there to `pick`."""
    each = np.arange(len(order))
    slot = order[each, pick].astype(np.int64)
    order[each, pick] = order[:, level]
    order[:, level] = slot
    return slot


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """Per signature one 64-bit key per band of `rows` slots; the band's number is part of it."""
    count = least.shape[1] // rows
    parts = least[:, : count * rows].copy().view(np.uint64).reshape(len(least), count, rows)
    key = np.arange(1, count + 1, dtype=np.uint64) * GOLDEN
    for k in range(rows):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def _signer(width: int, rows: int, slots: int):
    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = shingle_sets(part.column("text").to_pylist(), width)
            sizes = [len(s) for s in sets]
            keys = [k if n else None for n, k in zip(sizes, bands(signatures(sets, slots), rows))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("node"), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "bands"],
            )

    return sign


def signed(docs: DataFrame, width: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, node (stands for the text), n_shingles, bands (null for an empty set)."""
    small_batches(docs.sparkSession)
    rows = rows_per_band(percent, slots)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("node"),
        text_bytes().alias("text"),
    )
    return narrow.mapInArrow(
        _signer(width, rows, slots), "doc_id long, node binary, n_shingles long, bands array<long>"
    )


def _order(found: np.ndarray, values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Differences from the middle, those that fewer of the sampled texts have first. Each
    text of a group has its differences in the same order."""
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    held = np.where(values[at] == found, counts[at], 0)
    return found[np.lexsort((found, np.where(held * 2 > size, size - held, held)))]


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    lists = [None if x is None else x.view(np.int64) for x in columns[4]]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(list(x), pa.binary()) for x in columns[:3]), pa.array(list(columns[3]), pa.int64()),
         pa.array(lists, pa.list_(pa.int64()))],
        names=["g", "node", "centre", "size", "diff"],
    )


def _comparer(width: int, percent: int):
    """Reads blocks of rows, each with the sampled texts of its group first."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sample, middle = None, [], None

        def differences() -> list[tuple]:
            """Find the middle of the sampled texts; one block of a group tells their differences."""
            nonlocal values, counts, middle
            values, counts = np.unique(np.concatenate([x for _, x in sample]), return_counts=True)
            middle = values[counts * 2 > len(sample)]
            return [
                (block[0], name, None, len(x), _order(np.setxor1d(x, middle), values, counts, len(sample)))
                for name, x in sample if block[1] == 0
            ]

        values = counts = None
        family = False  # the block is of a large group
        for part in parts:
            rows = [part.column(c).to_pylist() for c in ("g", "part", "sampled", "large", "node")]
            out: list[tuple] = []
            for g, number, sampled, large, node, own in zip(
                    *rows, shingle_sets(part.column("text").to_pylist(), width)):
                if block != (g, number):
                    out += differences() if family and middle is None else []
                    block, sample, middle, roots, family = (g, number), [], None, [], large
                out += differences() if not sampled and middle is None else []
                linked = []
                for k, (_, x) in enumerate(sample):
                    if 100 * min(len(own), len(x)) >= percent * max(len(own), len(x)):
                        shared = len(np.intersect1d(own, x, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(x) - shared):
                            linked.append(k)
                # One link to each set of sampled texts that were not yet linked with each other.
                joined = {roots[k]: k for k in reversed(linked)}
                out += [(g, node, sample[k][0], len(own), None) for k in joined.values()]
                if joined:
                    roots = [min(joined) if r in joined else r for r in roots]
                if sampled:
                    roots.append(min(joined, default=len(sample)))
                    sample.append((node, own))
                elif large:
                    found = np.setxor1d(own, middle, assume_unique=True)
                    out.append((g, node, None, len(own), _order(found, values, counts, len(sample))))
            yield _compared(out)
        if family and middle is None:
            yield _compared(differences())

    return compare


def components(links: DataFrame) -> DataFrame:
    """node -> root, the least node it is linked with directly or through others. Union by
    least node and path compression, for all nodes at once: in turn each node passes its
    least neighbour to its larger neighbours (large star) and to its smaller ones (small
    star), until every node points at its root. Nothing reaches the driver but counts."""

    def least(edges: DataFrame) -> DataFrame:
        # Written out, so that the join after it sees two plain sides and splits a hot node.
        return durable(edges.groupBy("u").agg(F.min("v").alias("least")))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = durable(
        links.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"))
        .filter("u != v").distinct()
    )
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(
            both.join(least(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
            .filter("u != v").distinct()
        )
        small = large.join(least(large), "u")
        edges = durable(
            small.select(F.explode(F.array(
                F.struct(F.col("u"), F.col("least").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
            )).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(nodes: DataFrame) -> DataFrame:
    """(g, node): groups such that any two nodes that share a band share a group. A node's
    label is the least node it shares a band with; a bucket's group is the label that most
    of its nodes have, so the buckets of one family of copies come together."""
    bucketed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = durable(
        bucketed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1")
    )
    members = durable(bucketed.join(sizes, "key").select("key", "node", "least"))
    labels = durable(members.groupBy("node").agg(F.min("least").alias("label")))
    labelled = durable(members.select("key", "node").join(labels, "node"))
    home = durable(
        labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "label")).alias("most")).select("key", F.col("most.label").alias("g"))
    )
    return durable(labelled.select("key", "node").join(home, "key").select("g", "node").distinct())


def blocks(groups: DataFrame) -> DataFrame:
    """(g, part, sampled, large, node): each group in blocks of about BLOCK nodes, with up
    to SAMPLED nodes of the group in each block."""
    sizes = durable(groups.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1"))
    sized = durable(groups.join(sizes, "g").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")))
    large = F.col("size") > SAMPLED
    first = Window.partitionBy("g").orderBy("node")
    sample = durable(
        sized.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLED).drop("rank"))
    spread = sample.select(
        "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("sampled"),
        large.alias("large"), "node")
    others = sized.filter(large).join(sample.select("g", "node", F.lit(True).alias("taken")), ["g", "node"], "left")
    return spread.union(others.filter("taken is null").select(
        "g", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False), F.lit(True), "node"))


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (node, centre) that connect all texts whose similarity reaches the threshold
    and which share a band. Not every link is listed, but no two linked texts stay apart.

    Each text of a group is compared with the group's sampled texts, on full sets. In a small
    group these are all of them. In a large one each set is also written as its difference
    D from a middle, the shingles that most sampled texts have. The middle is only a point of
    reference: whatever it is, x and y differ in D(x) xor D(y), so with p percent they are
    linked if and only if |D(x) & D(y)| >= (a(x) + a(y)) / 2(100 + p), where
    a = (100 + p) |D| - (100 - p) size. Let m have the group's least a. A text with
    a(x) + a(m) <= 0 is linked with m. Any other link has a text without that, so its texts
    share differences; they are found by the first ones in a common order, rare ones first,
    as many as the bound leaves open, and confirmed on all differences. Pairs of one
    component are left out, so a large family costs what its stragglers share, not its square."""
    groups = grouped(nodes)
    needed = durable(groups.select("node").distinct())
    # Copies of a text become one in each task, before the shuffle that the join then uses too.
    once = docs.select(text_key().alias("node"), text_bytes().alias("text")).dropDuplicates(["node"])
    texts = durable(once.join(needed, "node"))
    rows = durable(blocks(groups)).join(texts, "node").repartition("g", "part")
    rows = rows.sortWithinPartitions("g", "part", F.desc("sampled"), "node")
    compared = durable(rows.mapInArrow(
        _comparer(width, percent), "g binary, node binary, centre binary, size long, diff array<long>"))
    near = compared.filter("centre is not null").select("node", "centre")
    unit = 100 + percent
    told = compared.filter("diff is not null").select(
        "g", "node", "size", F.size("diff").cast("long").alias("n"), "diff",
    ).withColumn("a", unit * F.col("n") - (100 - percent) * F.col("size"))
    middle = durable(told.groupBy("g").agg(F.min(F.struct("a", "node")).alias("m")))
    told = durable(told.join(middle, "g").select(
        "g", "node", "size", "n", "diff", "a", F.col("m.a").alias("least"), F.col("m.node").alias("centre")))
    near = near.union(told.filter("a + least <= 0 and node != centre").select("node", "centre"))
    root = durable(components(near))
    rooted = durable(told.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("centre"))
    # How many differences a partner shares at least: of a straggler's, and of any text's with a straggler.
    straggler = F.col("a") + F.col("least") > 0
    shared = F.ceil((F.col("a") + F.col("least")) / (2 * unit))
    of_any = F.greatest(F.ceil((F.col("a") - F.col("least") + 1) / (2 * unit)), F.lit(1))
    begun = rooted.withColumn("straggler", straggler).withColumn("open", F.greatest(
        F.col("n") - of_any + 1, F.when(straggler, F.col("n") - F.greatest(shared, F.lit(1)) + 1)).cast("int"))
    held = durable(
        begun.filter("open > 0")
        .select("g", "node", "size", "n", "a", "root", "straggler",
                (F.col("n") - of_any + 1).alias("any"), F.posexplode(F.slice("diff", F.lit(1), F.col("open"))).alias("at", "x"))
    )
    wanted = durable(
        held.groupBy("g", "x").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.max("straggler").alias("some"))
        .filter("some and one != other").select("g", "x")
    )
    held = durable(held.join(wanted, ["g", "x"]))
    one, other = held.filter("straggler").alias("o"), held.filter("at < any").alias("c")
    left = F.least(F.col("o.n") - F.col("o.at"), F.col("c.n") - F.col("c.at"))  # shared from here on, at most
    pairs = durable(
        one.join(other, (F.col("o.g") == F.col("c.g")) & (F.col("o.x") == F.col("c.x"))
                 & (F.col("o.root") != F.col("c.root")) & (F.col("o.a") + F.col("c.a") <= 2 * unit * left)
                 & (100 * F.col("o.size") >= percent * F.col("c.size")) & (100 * F.col("c.size") >= percent * F.col("o.size")))
        .select(F.col("o.g").alias("g"), F.col("o.node").alias("node"), F.col("c.node").alias("centre")).distinct()
    )
    own = told.select("g", "node", "a", "diff")
    theirs = told.select("g", F.col("node").alias("centre"), F.col("a").alias("b"), F.col("diff").alias("other"))
    found = pairs.join(own, ["g", "node"]).join(theirs, ["g", "centre"])
    found = found.filter(F.col("a") + F.col("b") <= 2 * unit * F.size(F.array_intersect("diff", "other")))
    return near.union(durable(found.select("node", "centre")))


def _rooted(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, least_id, root): each text that has a set, its least doc_id and its component."""
    nodes = durable(
        sets.filter("bands is not null").groupBy("node")
        .agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    )
    root = durable(components(links(docs, nodes, width, percent)))
    rooted = nodes.select("node", "least_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return durable(rooted)


def families(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(node, root): the component of each text that is not blank, by text_key; as near_copies."""
    return _rooted(docs, durable(signed(docs, width, percent)), width, percent).select("node", "root")


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct `width`-word shingles. Documents whose sets have
    100 * intersection >= percent * union are linked; component_id is the least doc_id
    reached over links. Null and blank texts have no set and no link: they are their own
    component. Rows with the same text are one node, whatever their doc_id; a repeated row
    has the same result each time. A null doc_id is never the least; documents without any
    doc_id have component_id null and are kept. Other columns are ignored."""
    sets = durable(signed(docs, width, percent))
    rooted = _rooted(docs, sets, width, percent)
    least = durable(rooted.groupBy("root").agg(F.min("least_id").alias("component")))
    component = durable(rooted.join(least, "root").select("node", "component"))
    out = sets.select("doc_id", "node", "n_shingles").join(component, "node", "left")
    out = out.withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )

"""Repeated passages against a search for every string, and the suffix arrays against sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import suffixes

KIND = "doc_id bigint, text string"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows: list[tuple]) -> list[tuple]:
    least: dict[bytes, int] = {}
    bodies = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, body in bodies:
        if doc is not None:
            for p in range(len(body) - 49):
                s = body[p : p + 50]
                least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, body in bodies:
        gone = np.zeros(len(body) + 1, dtype=bool)
        if doc is not None:
            for p in range(len(body) - 49):
                if least[body[p : p + 50]] < doc:
                    gone[p : p + 50] = True
        left = bytes(b for b, g in zip(body, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows: list[tuple], parts: int = 4) -> list[tuple]:
    got = suffixes.report(spark.createDataFrame(rows, KIND).repartition(parts)).select(COLUMNS).collect()
    got = sorted((tuple(r) for r in got), key=str)
    assert got == plain(rows)
    return got


def texts(seed: int, n: int, words: list[str], passages: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(5, 40)) for _ in range(passages)]
    rows = []
    for doc in range(n):
        body = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            body += rng.choice([" ", "\n", ""]) + rng.choice(shared)[rng.randint(0, 9) :] + say(rng.randint(0, 20))
        rows.append((doc * 3 + 1, body))
    copies = [(10_000 + i, rng.choice(rows)[1] + rng.choice(["", "!", " x"])) for i in range(n // 3)]
    return rows + copies


WORDS = ["alpha", "be", "çédille", "delta", "日本語", "f", "gh", "\x00", "zzz", "ten"]


@pytest.fixture
def small(monkeypatch):
    """Batches, shards and arrays so small that all merges happen."""
    for name, size in {"STRETCH": 700, "BATCH": 3000, "SHARD": 6000, "ARRAY": 1500, "BUCKET": 4000}.items():
        monkeypatch.setattr(suffixes, name, size)


def test_against_every_string(spark):
    got = check(spark, texts(1, 60, WORDS))
    assert sum(r[2] for r in got) > 1000


def test_one_task_of_small_batches(small):
    """The same functions without Spark, as settings changed here do not reach its workers."""
    for seed in range(4):
        rows = texts(seed, 50, WORDS)
        assert run_here(rows) == plain(rows)


def run_here(rows: list[tuple], shards: int = 5, buckets: int = 3, tasks: int = 3) -> list[tuple]:
    import pyarrow as pa

    tables = []
    bodies = [(d, hash(t) if t else 0, (t or "").encode()) for d, t in rows]
    for task in range(tasks):
        known = [b for b in bodies[task::tasks] if b[0] is not None and len(b[2]) >= 50]
        if known:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*known), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "key", "body"])
            tables += list(suffixes.Dealer(shards)([batch]))
    pieces = pa.Table.from_batches(tables)
    shard = np.array(pieces.column("shard"))
    found = pa.concat_tables([suffixes.Judge(buckets)(pieces.filter(pa.array(shard == s))) for s in range(shards)])
    placed = pa.RecordBatch.from_arrays(
        [pa.array([b[1] % buckets for b in bodies], pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*bodies), (pa.int64(), pa.int64(), pa.binary())))],
        names=["bucket", "doc_id", "key", "body"])
    texts_ = pa.Table.from_batches(list(suffixes._bundled([placed])))
    cut = []
    for bucket in range(buckets):
        own, spans = (t.filter(pa.array(np.array(t.column("bucket")) == bucket)) for t in (texts_, found))
        cut += suffixes._cut(own, spans).to_pylist()
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]),
                    hashlib.sha256(r["kept"]).hexdigest()) for r in cut), key=str)


def test_runs_of_one_character_and_periods(small):
    rows = [(1, "a" * 300), (2, "b" + "a" * 120 + "c" + "a" * 49 + "d"), (3, "ab" * 200), (4, "ba" * 30 + "x" + "ab" * 24), (5, "a" * 50)]
    assert run_here(rows) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(str(i * 7919 % 10007) for i in range(40_000))
    rows = [
        (None, "w" * 60), (4, "w" * 60), (None, None), (5, None), (6, ""), (7, "w" * 49), (8, "w" * 50),
        (9, "same number " * 9), (9, "same number " * 9), (9, "same number " * 8 + "other"), (10, "same number " * 9),
        (2, long), (3, long[1000:100_000] + "!"), (-5, "negative ids are smaller than all of the others, as they ought to be"),
        (0, "negative ids are smaller than all of the others, as they ought to be"),
    ]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    empty = suffixes.report(spark.createDataFrame([], KIND))
    assert empty.columns == COLUMNS and empty.count() == 0
    rows = texts(3, 20, WORDS)
    wide = spark.createDataFrame([(*r, "k", "b", "p") for r in rows], f"{KIND}, key string, body string, bucket string")
    assert sorted((tuple(r) for r in suffixes.report(wide).collect()), key=str) == plain(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00", min_size=1, max_size=40), min_size=1, max_size=12))
def test_suffix_array_and_prefixes(pieces):
    bodies = [p.encode() for p in pieces]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    lengths = np.array([len(b) for b in bodies])
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    order = suffixes.suffix_array(data, ends)
    suffix = lambda p: data[p : ends[p]].tobytes()
    assert order.tolist() == sorted(range(len(data)), key=lambda p: (suffix(p), p))
    common = suffixes.common_prefixes(data, starts, lengths, order)
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

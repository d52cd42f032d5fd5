"""Vector codes against plain Lloyd rounds, and the bounds at work."""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pytest
from check_oracle import differences, duck
from conftest import SMALL

from ledgerlake.llm import queries, vectorcodes

KIND = "vec_id bigint, embedding array<float>, label int"


def plain(rows: list[tuple]) -> dict:
    """vec_id -> (code, error), label -> error, and the digest of the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: r[0])
    whole = [[math.floor(1024 * struct.unpack("f", struct.pack("f", c))[0]) for c in r[1]] for r in kept]
    width = len(whole[0]) // 4
    parts = [[v[p * width : (p + 1) * width] for v in whole] for p in range(4)]
    books = [p[:256] for p in parts]

    def nearest(p: int, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        after = []
        for p in range(4):
            of = [nearest(p, x)[1] for x in parts[p]]
            book = []
            for k, entry in enumerate(books[p]):
                own = [x for x, o in zip(parts[p], of) if o == k]
                book.append([sum(c) // len(own) for c in zip(*own)] if own else entry)
            after.append(book)
        books = after
    found = [[nearest(p, parts[p][i]) for p in range(4)] for i in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return {
        r[0]: ("".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest)
        for r, f, e in zip(kept, found, errors)
    }


def found(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame(rows, KIND).repartition(5)
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.coded(df).collect()}


def rows_of(seed: int, n: int, width: int, spread: float, copies: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (40, width))
    rows = [(i, (centres[i % 40] + rng.normal(0, spread, width)).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    return rows + [(n + i, rows[3][1], 5) for i in range(copies)]


@pytest.mark.parametrize("seed, n, width, spread, copies", [
    (1, 400, 8, 0.3, 0), (2, 330, 4, 0.0, 300), (3, 700, 12, 0.002, 40), (4, 20, 8, 1.0, 0), (5, 300, 8, 3000.0, 0),
])
def test_against_plain_rounds(spark, seed, n, width, spread, copies):
    rows = rows_of(seed, n, width, spread, copies)
    assert found(spark, rows) == plain(rows)


def test_rows_that_go(spark):
    rows = rows_of(6, 300, 8, 0.3)
    odd = [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [0.0] * 7 + [float("inf")], 2), (1003, [0.5] * 7 + [None], 2)]
    assert found(spark, rows + odd) == plain(rows)
    # Another length than that of the least vec_id.
    assert found(spark, rows + [(1004, [0.1, 0.2], 1), (1005, [], 1)]) == plain(rows)


def test_rows_without_or_with_one_vec_id_and_clashing_columns(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 4.0], 1), (5, [9.0, 2.0, 3.0, 4.0], None)]
    df = spark.createDataFrame(
        [(*r, "x", "near", "low", "sums") for r in rows], f"{KIND}, x string, near string, low string, sums string")
    got = vectorcodes.coded(df).collect()
    assert sorted((r.vec_id or -1, r.code, r.error) for r in got) == [(-1, "00000000", 0), (5, "00000000", 0), (5, "01000000", 0)]


def test_empty_table(spark):
    out = vectorcodes.coded(spark.createDataFrame([], KIND))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_bounds_spare_work_and_lists_get_shorter(spark):
    rows = rows_of(7, 3000, 16, 0.02)
    seen = []
    vectorcodes.learnt(
        vectorcodes.usable(spark.createDataFrame(rows, KIND)), lambda round_, kept, looked: seen.append((kept, looked)))
    assert seen[0][0] == vectorcodes.MOST and seen[-1][0] < vectorcodes.MOST
    everything = sum(seen[0][1]) * vectorcodes.ENTRIES
    for _, looked in seen[1:]:
        assert (looked * np.arange(len(looked))).sum() < everything / 5


def test_query_equals_sql(spark):
    name = "op13_vectorcodes"
    assert differences(queries.queries()[name](spark, SMALL), duck(SMALL), queries.oracle_sql()[name]) is None

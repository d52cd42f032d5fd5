"""Conversation repair against a plain search over whole conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import SMALL

from ledgerlake.llm import turnrepair

KIND = "conv_id bigint, turn bigint, role string, text string"
BLANKS = "\x20\t\n\x0b\x0c\r"
REPORT = ["conv_id", *turnrepair._REPORT]


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(conv: int | None, rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode()))
    counts, seen, marks = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, _, role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        mark = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        if mark:
            counts[mark] += 1
        marks.append(mark)
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    # For each last initial the least (cost, audit, lines), turn by turn from the end. No run of
    # inserted turns longer than four can be cheapest.
    best = {q: [] for q in ("", "s", "u", "a")}
    for q in best:
        tail, state = [], q
        while state in ("s", "u"):
            state = "u" if state == "s" else "a"
            tail.append({"u": "user:", "a": "assistant:"}[state])
        best[q] = (3 * len(tail), "I" * len(tail), tail)
    for (_, _, role, text), mark in zip(reversed(rows), reversed(marks)):
        before = {}
        for q in best:
            options, inserted, state = [], [], q
            for many in range(5):
                fix = lambda cost, edit, lines, then: (
                    3 * many + cost + then[0], "I" * many + edit + then[1], inserted + lines + then[2])
                options.append(fix(4, "D", [], best[state]))
                if mark not in ("blank", "duplicate"):
                    left = 3 if mark else 0
                    due = "a" if state == "u" else "u"
                    options.append(fix(3 + left, "R", [{"u": "user:", "a": "assistant:"}[due] + text], best[due]))
                    if (state, role[:1]) in legal:
                        options.append(fix(left, "K", [f"{role}:{text}"], best[role[:1]]))
                state = "a" if state == "u" else "u"
                inserted = inserted + [{"u": "user:", "a": "assistant:"}[state]]
            before[q] = min(options, key=lambda o: o[:2])
        best = before
    cost, audit, lines = best[""]
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, *counts.values(), illegal, cost, audit, digest)


def check(spark, rows: list[tuple], parts: int = 3) -> None:
    got = [tuple(r) for r in turnrepair.report(spark.createDataFrame(rows, KIND).repartition(parts)).select(REPORT).collect()]
    after = damaged(rows)
    wanted = [expected(conv, [r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def made(seed: int, conversations: int, longest: int, roles: list, texts: list) -> list[tuple]:
    rng = random.Random(seed)
    return [
        (conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.random())]) + rng.choice([".", "!", "", " ? "]))
        for conv in range(conversations) for turn in range(rng.randint(1, longest))
    ]


ROLES = ["user", "assistant", "system", "tool", "", "under"]
TEXTS = ["a.", "", " ", "b", "same text of many"]


def test_small_conversations(spark):
    check(spark, made(1, 150, 9, ROLES, TEXTS))


@pytest.mark.parametrize("roles", [["tool"], ROLES, ["user"], ["user", "assistant"]])
def test_long_conversations_over_many_chunks_and_tasks(spark, conf, monkeypatch, roles):
    """With roles that no sequence takes, vectors never converge and links must reach to the end."""
    monkeypatch.setattr(turnrepair, "CHUNK_BITS", 2)
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="7")
    check(spark, made(2, 3, 200, roles, ["one", "two", "three"]) + made(3, 20, 6, roles, TEXTS))


def test_copies_of_a_turn_are_dealt_out(spark, conf, monkeypatch):
    monkeypatch.setattr(turnrepair, "CHUNK_BITS", 3)
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="6")
    rows = [(1, 2, "user", "again and again.")] * 300 + [(2, 1, "user", "x."), (2, 2, "assistant", "y.")]
    check(spark, rows)
    laid = turnrepair._laid_out(spark.createDataFrame(rows, KIND))
    sizes = [r["count"] for r in laid.groupBy(laid.place.bitwiseAND(-(2**33))).count().collect()]
    assert len(sizes) > 3


def test_nulls_ties_and_long_texts(spark):
    long = "word " * 60_000
    check(spark, [
        (None, 1, "user", "a."), (None, None, "assistant", "b."), (7, None, None, None), (8, 1, None, "x."),
        (9, 1, "user", long + "."), (9, 2, "assistant", long), (9, 2, "assistant", "short."), (9, 2, "assistant", "short."),
        (10, 3, "user", "ü?"), (10, 3, "user", "a!"), (10, -4, "assistant", "é.\n"),
    ])


def test_nothing_left_and_empty_table(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = turnrepair.report(spark.createDataFrame([(5, dropped, "user", "gone.")], KIND)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turnrepair.report(spark.createDataFrame([], KIND)).count() == 0


def test_clashing_columns(spark):
    rows = made(4, 10, 5, ROLES, TEXTS)
    extra = ", ".join(f"{c} string" for c in ("place", "mark", "code", "at", "audit", "kind", "times", "col"))
    wide = spark.createDataFrame([(*r, *["z"] * 8) for r in rows], f"{KIND}, {extra}")
    narrow = spark.createDataFrame(rows, KIND)
    assert sorted(map(str, turnrepair.report(wide).collect())) == sorted(map(str, turnrepair.report(narrow).collect()))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_edits_are_given_out(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "So?")]
    out = turnrepair.edited(spark.createDataFrame(rows, KIND)).orderBy("step").collect()
    # Two inserts cost 6, as two rerolls do, and are ASCII-less.
    assert [(r.edit, r.was, r.role, r.text) for r in out] == [
        ("I", None, "user", ""), ("K", "assistant", "assistant", "Hello."), ("K", "user", "user", "So?"), ("I", None, "assistant", "")]
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", " ")]
    out = turnrepair.edited(spark.createDataFrame(rows, KIND)).orderBy("step").collect()
    assert [(r.edit, r.fault, r.role, r.text) for r in out] == [
        ("I", None, "user", ""), ("K", None, "assistant", "Hello."), ("D", "blank", None, None)]


def test_number_of_cost_vectors():
    assert len(turnrepair._vectors()) < 64

"""Preference pairs against a plain walk; spans of long lists of numbers."""

import time

import pytest

from ledgerlake.llm import pii, preferences
from ledgerlake.llm.queries import op4_preferences

SCHEMA = "conv_id long, turn long, role string, text string"
LEAST = -(2**63)


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add((LEAST if turn is None else turn, role or "", text or ""))
    out, earlier = {}, []
    for conv in sorted(talks):
        chosen = sorted(talks[conv])
        taught = [t for t in chosen if t[1] == "assistant"]
        rejected = chosen
        if taught:
            turn = taught[-1][0]
            same = [t[2] for t in earlier if t[0] == turn]
            place = sum(t[0] == turn for t in taught)
            other = same[place - 1] if place <= len(same) else ""
            rejected = sorted({*chosen[:], (turn, "assistant", other)} - ({taught[-1]} if other != taught[-1][2] else set()))
        bare = [[t[1:] for t in side] for side in (chosen, rejected)]
        n = 0
        while n < min(map(len, bare)) and bare[0][n] == bare[1][n]:
            n += 1
        told = lambda said: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in said)
        masks = []
        for side in bare:
            at, mask = 0, []
            for role, text in side[n:]:
                start = at + len(role) + 5
                at = start + len(text) + 8
                mask += [(start, at)] if role == "assistant" else []
            masks.append(mask)
        out[conv] = (n, told(bare[0][:n]), told(bare[0][n:]), told(bare[1][n:]), *masks)
        earlier = taught
    return out


def given(frame):
    return {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask])
            for r in frame.collect()}


ODD = [
    (10, 0, "user", "q"), (10, 1, "assistant", "ten"), (20, 0, "user", "q"), (20, 1, "assistant", "twenty"),
    (20, 1, "assistant", "twenty"), (-7, 1, "assistant", "minus"), (511, 1, "assistant", "a"), (511, 1, "assistant", "b"),
    (512, 1, "assistant", "c"), (512, 1, "assistant", "d"), (512, None, None, None), (10**6, 1, "assistant", "a" * 50000),
    (2**62, 1, "assistant", "far"), (-(2**63), 1, "assistant", "least"), (None, 1, "assistant", "none"), (600, 0, "tool", "only"),
    (601, 1, "assistant", ""), (602, 1, "assistant", "x"), (602, 1, "user", "y"), (603, None, "assistant", "x"), (604, None, "assistant", "z"),
]


def test_pairs_equal_a_walk_in_order_of_conv_id(spark):
    turns = spark.createDataFrame(ODD, SCHEMA)
    want = plain(ODD)
    assert "ten" in want[20][3]
    assert given(preferences.pairs(turns)) == want
    assert given(preferences.formatted(preferences.pairs_of(turns.repartition(7)))) == want


@pytest.mark.parametrize("extra", ["block", "chosen", "pair_id"])
def test_empty_tables_and_clashing_names(spark, extra):
    turns = spark.createDataFrame([(*r, "x") for r in ODD], f"{SCHEMA}, {extra} string")
    assert given(preferences.pairs(turns)) == plain(ODD)
    assert preferences.pairs(turns.limit(0)).count() == 0


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert given(op4_preferences(spark, sf)) == plain([tuple(r) for r in rows])


def test_texts_move_once(spark):
    plan = preferences.pairs(spark.createDataFrame(ODD, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1


def test_long_lists_of_numbers_take_time_in_proportion():
    def seconds(n):
        text = " ".join(f"call 0{k % 9}{k:05d} {k % 10}11 22" for k in range(n))
        start = time.process_time()
        pii.candidates(text)
        return time.process_time() - start

    seconds(100)
    assert seconds(16000) < 16 * max(seconds(2000), 0.02)

"""Sampling without replacement against the listed segmentations of a short text."""

import random
import re
import tracemalloc

import numpy as np

from ledgerlake.llm import segmentation

KEYS = np.arange(1, 6001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def listed(lattices, chunk):
    """Every segmentation of a chunk with its probability."""
    open_paths, done = [(int(lattices.nodes([chunk])[0]), (), 0.0)], {}
    while open_paths:
        node, ids, log = open_paths.pop()
        for edge in range(lattices.begin[node], lattices.begin[node + 1]):
            to, further = int(lattices.edges["to"][edge]), log + lattices.edges["log"][edge]
            path = (*ids, int(lattices.edges["id"][edge]))
            if to < 0:
                done[path] = float(np.exp(further))
            else:
                open_paths.append((to, path, further))
    return done


def test_order_and_inclusion():
    lattices = segmentation.Lattices(segmentation.vocabulary())
    text = "then"
    chance = listed(lattices, segmentation.chunks(text)[0])
    found = segmentation.sampled(lattices, [text] * len(KEYS), KEYS, 3)
    pairs, weighted = {}, 0.0
    for own in found:
        ids = [tuple(i.tolist()) for i, _, _ in own]
        assert len(set(ids)) == 3
        assert all(abs(np.exp(log) - chance[i]) < 1e-9 for i, (_, log, _) in zip(ids, own))
        pairs[tuple(ids[:2])] = pairs.get(tuple(ids[:2]), 0) + 1
        # Weighted by its inclusion, each segmentation counts once on average.
        weighted += sum(np.exp(log - inclusion) for _, log, inclusion in own)
    for (a, p) in chance.items():
        for (b, q) in chance.items():
            if a != b:
                assert abs(pairs.get((a, b), 0) / len(KEYS) - p * q / (1 - p)) < 0.03
    assert abs(weighted / len(KEYS) - 1) < 0.05


def test_few_segmentations_are_all_given():
    lattices = segmentation.Lattices(segmentation.vocabulary())
    chance = listed(lattices, segmentation.chunks("an")[0])
    for own in segmentation.sampled(lattices, ["an"] * 20, KEYS[:20], len(chance) + 3):
        assert {tuple(i.tolist()) for i, _, _ in own} == set(chance)
        assert all(inclusion == 0.0 for _, _, inclusion in own)


def test_a_text_is_drawn_alike_alone_and_in_company():
    texts = ["", "a", "the cat sat on the mat " * 40, "\n\n", "日本 x ▁ then", "word " * 3000, "the cat"]
    pieces = segmentation.vocabulary()
    together = segmentation.sampled(segmentation.Lattices(pieces), texts, KEYS[: len(texts)], 4)
    for k, text in enumerate(texts):
        alone = segmentation.sampled(segmentation.Lattices(pieces), [text], KEYS[k : k + 1], 4)[0]
        assert [i.tolist() for i, _, _ in alone] == [i.tolist() for i, _, _ in together[k]]
        assert np.allclose([x[1:] for x in alone], [x[1:] for x in together[k]])
        assert all(segmentation.decoded(pieces, i.tolist()) == text for i, _, _ in alone if len(i))


def test_single_numbers_equal_those_of_a_batch():
    row = segmentation._Row(int(KEYS[7]), np.empty(0, dtype=np.int64))
    one = [row.draw() for _ in range(9)]
    many = segmentation._uniform(np.repeat(KEYS[7:8], 10), np.arange(10), segmentation.DRAWS)
    assert one == many[1:].tolist()


def test_memory_follows_the_characters_not_the_rows_of_a_batch():
    """Long rows of one batch are drawn a few at a time, and lattices that no longer fit go."""
    words = ["".join(map(chr, np.random.default_rng(k).integers(97, 123, 7))) for k in range(60_000)]
    texts = [" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)] + ["", "a b"]
    runs = list(segmentation.together(texts))
    assert [k for run in runs for k in range(*run.indices(len(texts)))] == list(range(len(texts)))
    assert all(
        run.stop - run.start == 1 or sum(map(len, texts[run])) <= segmentation.TOGETHER for run in runs)
    assert len(runs) > 1 and list(segmentation.together([])) == []
    lattices = segmentation.Lattices(segmentation.vocabulary())
    keys, found = KEYS[: len(texts)], []
    tracemalloc.start()
    for run in runs:
        found += segmentation.sampled(lattices, texts[run], keys[run], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6, peak
    assert [segmentation.decoded(lattices.pieces, own[0][0].tolist()) for own in found if len(own[0][0])] == [
        t for t in texts if t]


def test_chunks_are_those_of_the_pattern():
    space = segmentation.SPACE
    pattern = re.compile(f"\n|{space}+[^{space}\n]*|[^{space}\n]+")
    draw = random.Random(5)
    texts = ["".join(draw.choices("  \nab▁é\t日", k=draw.randint(1, 12))) for _ in range(5000)] + [" " * 999 + "x  "]
    for text in texts:
        assert segmentation.chunks(text) == pattern.findall(
            space + text.replace(space, segmentation.MARK).replace(" ", space))


def test_every_step_of_the_vocabulary_is_found():
    pieces = segmentation.vocabulary()
    lattices = segmentation.Lattices(pieces)
    texts = [p for p in pieces[segmentation.FIRST_PIECE :] if len(p) <= segmentation.LONGEST]
    codes = np.array([ord(c) for p in texts for c in p], dtype=np.int64)
    sizes = np.array([len(p) for p in texts])
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    got = {}
    for at, length, ids, _ in lattices._pieces_at(codes, left):
        got.update({(int(a), length): int(i) for a, i in zip(at, ids)})
    assert all(pieces[got[int(s), len(p)]] == p for s, p in zip(starts, texts))


def test_lattices_of_many_words_do_not_pile_up():
    """A worker sees new words without end; what it remembers stays small, and what it draws the same."""
    pieces = segmentation.vocabulary()
    letters = np.random.default_rng(3).integers(97, 123, (160_000, 7)).astype(np.uint8)
    words = [bytes(w).decode() for w in letters]
    lattices, most = segmentation.Lattices(pieces), 0
    for k in range(0, len(words), 20_000):
        text = " ".join(words[k : k + 20_000])
        found = segmentation.sampled(lattices, [text], KEYS[:1], 2)[0]
        most = max(most, sum(column.nbytes for column in (lattices.begin, *lattices.edges.values())))
    assert most < 55e6, most
    alone = segmentation.sampled(segmentation.Lattices(pieces), [text], KEYS[:1], 2)[0]
    assert [i.tolist() for i, _, _ in found] == [i.tolist() for i, _, _ in alone]

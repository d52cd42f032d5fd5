"""Sketches against the sets they stand for."""

import random

import numpy as np
import pytest

from ledgerlake.llm import sketches
from ledgerlake.llm.common import shingle_sets


def made(count, size, seed):
    draw = random.Random(seed)
    return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(size)) for _ in range(count)]


def seen(small, large):
    one, other = (sketches.sketches([t.encode() for t in x]) for x in (small, large))
    return [sketches.contained(a, b) for a, b in zip(one, other)]


def test_short_texts_are_seen_inside_long_ones():
    short, before, after = made(300, 10, 1), made(300, 250, 2), made(300, 250, 3)
    whole = seen(short, [f"{b} {s} {a}" for s, b, a in zip(short, before, after)])
    assert sum(x < 1 for x in whole) < 15
    assert max(seen(short, [f"{b} {a}" for b, a in zip(before, after)])) == 0


@pytest.mark.parametrize("part", [0.25, 0.5, 0.75])
def test_containment_is_near_that_of_the_sets(part):
    long = made(200, 600, 4)
    other = made(200, 200, 5)
    short = [" ".join(t.split()[: int(200 * part)] + o.split()[int(200 * part) :]) for t, o in zip(long, other)]
    told = seen(short, long)
    exact = []
    for s, t in zip(short, long):
        a, b = shingle_sets([s.encode(), t.encode()], sketches.WIDTH)
        exact.append(len(np.intersect1d(a, b)) / len(a))
    assert abs(np.mean(told) - np.mean(exact)) < 0.02
    assert max(abs(x - y) for x, y in zip(told, exact)) < 0.25


def test_merging_equals_the_sketch_of_the_union():
    a, b = shingle_sets([t.encode() for t in made(2, 300, 6)], sketches.WIDTH)
    assert np.array_equal(sketches.merged(sketches.sketch(a), sketches.sketch(b)), sketches.sketch(np.union1d(a, b)))
    assert np.array_equal(sketches.read(sketches.written(sketches.sketch(a))), sketches.sketch(a))

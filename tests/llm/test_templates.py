"""Templates of benchmark items in texts, against a plain walk over words."""

import random

import pytest
import regex

from ledgerlake.llm import templates
from ledgerlake.llm.templates import LITERAL, NAME, NUMBER, UNIT, UNITS, WIDTH

ITEM = "Anna walked 12 km to the old mill and then 12 km back to the small town before the rain."


def frames(spark, texts, items):
    return (
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def walked(text):
    """(kind, value) of each word."""
    out = []
    for m in regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+", text):
        word, start, end = m[0], m.start(), m.end()
        kind = word.lower()
        if regex.match(r"\p{N}", word):
            kind = NUMBER
        elif regex.fullmatch(r"\p{Lu}[\p{Ll}\p{M}]+", word) and regex.search(r"[\p{L}\p{N},;] $", text[:start]):
            kind = NAME
        elif kind in UNITS.split() and regex.search(r"\p{N}[ \t\n\x0b\f\r]*$", text[:start]) and not regex.match(r"\p{N}", text[end:]):
            kind = UNIT
        out.append((kind, word.lower()))
    return out


def windows_of(both):
    """(window, bare) at each place."""
    out = []
    for i in range(max(1, len(both) - WIDTH + 1)):
        part = both[i : i + WIDTH]
        bare = sum(k in (NAME, UNIT, NUMBER) for k, _ in part) > WIDTH - LITERAL
        out.append((tuple(part_[1] if bare else part_[0] for part_ in part) + ((bare, len(part)),), bare))
    return out


def holds(text, item, percent=80):
    """The largest share of a copy that fits, or None."""
    said, asked = walked(text or ""), walked(item or "")
    if not said or not asked:
        return None
    windows = windows_of(asked)
    everything = 2 * sum(b for _, b in windows) >= len(windows)
    windows = [(k, w) for k, (w, bare) in enumerate(windows) if everything or not bare]
    slack = max(1, len(asked) * (100 - percent) // 100)
    hits = [(p, q) for p, (w, _) in enumerate(windows_of(said)) for q, v in windows if v == w]
    best, names = None, dict(windows)
    for copy in {(p - q) // slack + d for p, q in hits for d in (0, -1)}:
        mine = [(p, q) for p, q in hits if copy <= (p - q) // slack <= copy + 1]
        share = len({names[q] for _, q in mine}) / len(set(names.values()))
        values = {}
        for p, q in mine:
            for k in range(WIDTH):
                if q + k < len(asked) and asked[q + k][0] in (NAME, UNIT, NUMBER) and p + k < len(said):
                    values.setdefault(asked[q + k][1], set()).add(said[p + k][1])
        if share * 100 >= percent - 1e-9 and all(len(v) == 1 for v in values.values()):
            best = max(best or 0, share)
    return best


def test_random_texts_against_a_walk(spark):
    draw = random.Random(5)
    plain = "the old mill has two doors and every door is open".split()
    filler = lambda: draw.choice(
        [draw.choice(plain), draw.choice(plain), str(draw.randrange(3)), draw.choice(["Anna", "Bert"]), f"{draw.randrange(3)} km", "2.5"])
    items = [(k, " ".join(filler() for _ in range(draw.randrange(1, 14)))) for k in range(60)]
    items += [(60 + k, t) for k, (_, t) in enumerate(items[:5])] + [(99, None), (98, ""), (None, "no id at all here now")]
    texts = [None, "", " ", *(t for _, t in items[:30])]
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            said = draw.choice(items[:60])[1].split()
            if draw.random() < 0.6:  # other figures
                new = {str(n): str(draw.randrange(7)) for n in range(3)}
                said = [new.get(w, w) if draw.random() < 0.95 else "9" for w in said]
            if draw.random() < 0.4:  # a word put in
                said.insert(draw.randrange(len(said) + 1), "zzz")
            parts += [*said, *(filler() for _ in range(draw.randrange(3)))]
        texts.append(" ".join(parts))
    docs, bench = frames(spark, texts, items)
    got = {r.doc_id: r for r in templates.report(docs, bench).collect()}
    assert len(got) == len(texts)
    caught = 0
    for k, text in enumerate(texts):
        found = {i: s for i, t in items if i is not None and (s := holds(text, t)) is not None}
        assert got[k].contaminated == bool(found), text
        assert got[k].n_items == len(found), text
        assert got[k].share == pytest.approx(max(found.values(), default=0.0))
        assert {int(s) for s in got[k].shapes.split(",") if s} <= set(found)
        caught += bool(found)
    assert 40 < caught < len(texts) - 20


def test_scattered_windows_are_no_copy(spark):
    words = ITEM.split()
    scattered = " zzz ".join(" ".join(words[i : i + 5]) for i in range(len(words) - 4))
    docs, bench = frames(spark, [scattered, f"zzz {ITEM} zzz"], [(1, ITEM)])
    assert [r.contaminated for r in templates.report(docs, bench).orderBy("doc_id").collect()] == [False, True]


def test_a_second_copy_that_fits_is_enough(spark):
    torn = ITEM.replace("then 12", "then 13")
    fits = ITEM.replace("12", "40").replace(" before the rain.", "")
    docs, bench = frames(spark, [torn, f"{torn} So it was: {fits}"], [(1, ITEM)])
    assert [r.contaminated for r in templates.report(docs, bench).orderBy("doc_id").collect()] == [False, True]


def test_items_of_figures_are_found_by_their_figures(spark):
    item = "12 km 7 kg 15 3 4 sum 9 10"
    docs, bench = frames(spark, [f"first then {item} so", item.replace("7", "8"), "1 2 3 4 5 6 7 8 9"], [(1, item)])
    assert [r.contaminated for r in templates.report(docs, bench).orderBy("doc_id").collect()] == [True, False, False]


def test_many_items_of_one_template_are_looked_up_once(spark):
    items = [(k, ITEM.replace("12", str(k + 100))) for k in range(400)]
    docs, bench = frames(spark, [ITEM.replace("12", str(k)) for k in range(50)], items)
    assert templates.contaminated(docs, bench).count() == 50
    rows = templates.report(docs, bench).collect()
    assert {(r.n_items, r.n_shapes, r.shapes) for r in rows} == {(400, 1, "0")}


def test_odd_rows(spark):
    docs, bench = frames(spark, [ITEM, ITEM, None, "", "word " * 20_000], [(1, ITEM), (1, ITEM), (2, None), (3, "")])
    docs = docs.union(docs.limit(1)).union(spark.createDataFrame([(None, ITEM)], docs.schema))
    rows = templates.report(docs, bench).collect()
    assert len(rows) == 7 and sum(r.contaminated for r in rows) == 4 and {r.n_items for r in rows} == {0, 1}
    nothing, none = docs.limit(0), bench.limit(0)
    assert templates.report(nothing, bench).count() == 0
    assert not any(r.contaminated for r in templates.report(docs, none).collect())
    named = docs.selectExpr("*", "doc_id as _node", "text as item_id", "doc_id as shape", "text as window")
    kept = templates.decontaminated(named, bench)
    assert kept.columns == named.columns
    assert sorted(str(r._node) for r in kept.collect()) == ["2", "3", "4"]

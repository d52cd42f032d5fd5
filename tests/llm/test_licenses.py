"""Licence scans against a plain walk over the words of each text."""

import math
import re

import pytest

from ledgerlake.llm import licenses
from ledgerlake.llm.queries import op7_licenses

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(CAPITALS))


def places(words, phrase):
    parts = phrase.split()
    return [k for k in range(len(words)) if words[k : k + len(parts)] == parts]


def plain(texts):
    """What scanned() has to give, by trying every beginning of every template."""
    split = [words_of(t) for t in texts]
    seen = {w: sum(w in set(x) for x in split) for w in licenses.VOCABULARY}
    idf = {w: math.log((1 + len(texts)) / (1 + n)) for w, n in seen.items()}
    out = []
    for words in split:
        at = {label: places(words, phrase) for phrase, label in licenses.PHRASES.items()}
        base = sorted(k for k, v in at.items() if v)
        starts = sorted(p for v in at.values() for p in v)
        found = {}
        for label, templates in licenses.TEMPLATES.items():
            if not any(places(words, p) for p in licenses.MANDATORY[label]):
                continue
            for template in (t.split() for t in templates):
                seeds = sorted(set(template) & set(words), key=lambda w: (-idf[w], w))[: licenses.SEEDS]
                begins = {}
                for k, w in enumerate(words):
                    if w in seeds:
                        for p, x in enumerate(template):
                            if x == w:
                                begins.setdefault(k - p, set()).add(w)
                most = max((len(set().union(*(begins.get(b + d, set()) for d in range(licenses.NEAR + 1)))) for b in begins), default=0)
                if seeds and most / len(seeds) >= licenses.AGREE:
                    found[label] = max(found.get(label, 0.0), most / len(seeds))
        out.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base),
                    ",".join(sorted({*base, *found})), 1.0 if base else max(found.values(), default=0.0)))
    return out


def rows_of(frame):
    return [tuple(r)[1:] for r in frame.orderBy("doc_id").collect()]


def made():
    whole = [t for texts in licenses.TEMPLATES.values() for t in texts]
    halves = [" ".join(t.split()[k::2]) for t in whole for k in (0, 1)]
    changed = [t.replace(" of ", " in any of ").replace(" the ", " ") for t in whole]
    return [
        None, "", " ", "-", "MIT License", "mit--license", "smit license", "mit licenses", "mit license mit license mit",
        "General Public License general public LICENSE", "K MIT License", "İ apache\x00license", "é mit license é",
        "mit Kicense", "Apache\nLicense " * 3, *whole, *whole, *(t.upper() for t in whole), *halves, *changed,
        " ... ".join(whole), "word " * 20000 + whole[0] + " word" * 20000, "the software " * 5000 + "mit license",
    ]


def test_equal_to_a_walk_over_the_words(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(licenses.scanned(docs)) == plain(texts)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len({r.doc_id for r in docs}) == len(docs)
    assert rows_of(op7_licenses(spark, SF)) == plain([r.text for r in docs])


def test_each_whole_licence_has_its_label(spark):
    labelled = [(k, label, t) for k, (label, t) in enumerate((x, t) for x, ts in licenses.TEMPLATES.items() for t in ts)]
    docs = spark.createDataFrame([(k, f"see: {t}. end") for k, _, t in labelled], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    for k, label, text in labelled:
        assert any(places(text.split(), p) for p in licenses.MANDATORY[label]), text
        assert label in got[k].labels.split(","), (label, got[k])


@pytest.mark.parametrize("extra", ["norm", "words", "wanted", "_held", "n_base"])
def test_odd_tables(spark, extra):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scanned(none).count() == 0
    docs = spark.createDataFrame([(1, "mit license", "x"), (1, "mit license", "x"), (None, None, None)], f"doc_id long, text string, {extra} string")
    rows = licenses.scanned(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.labels, r.n_words) for r in rows] == [(None, "", 0), (1, "mit", 2), (1, "mit", 2)]


def test_the_plan_does_not_grow_with_the_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    lines = lambda: licenses.scanned(docs)._jdf.queryExecution().analyzed().treeString().count("\n")
    before = lines()
    monkeypatch.setattr(licenses, "TEMPLATES", {k: v * 20 for k, v in licenses.TEMPLATES.items()})
    assert lines() == before
    assert licenses.scanned(docs).first().labels == "mit"

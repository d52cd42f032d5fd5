"""The pipeline's whole run against plain Python over a small table."""

import re

from conftest import SMALL
from pyspark.sql import functions as F
from test_templates import holds

import corpus_pipeline
from ledgerlake.llm import langid, secret_scan, segmentation

TOKEN = "password=abcd1234EFGH5678"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(rows):
    """Of linked rows that with the least id stays, rows without id last; blank texts all stay."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [r for k, r in enumerate(rows) if top(k) == k]


def write(spark, folder, docs, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_against_plain_python(spark, tmp_path):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(12)
    items = [r.text for r in bench.collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 2000").orderBy("doc_id").limit(90)
    given = docs.filter("lang is not null").first()
    base = given.text
    turned, ordered = " ".join(reversed(base.split())), " ".join(sorted(base.split()))  # no near copies
    made = [(10_001, f"{base} {TOKEN}"), (10_002, f"{base} {TOKEN}"), (10_002, f"{base} {TOKEN}"), (None, f"{base} {TOKEN}"),
            (10_003, f"{turned} {items[0]}"), (10_008, f"{ordered} {TOKEN}"), (10_004, None), (10_005, ""), (10_006, "12 34 !"), (10_007, f"{base} " * 300), (None, None)]
    extra = [tuple({"doc_id": k, "text": t}.get(c, given[c]) for c in docs.columns) for k, t in made]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("_node", F.lit(1)).withColumn("score", F.lit("x"))
    sf_dir = write(spark, tmp_path, docs, bench)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.Rows(langid.learn_from(docs))
    named = [(r, langid.predict(r[1], model)) for r in rows if r[1]]
    known = [r for r, (lang, score) in named if lang != langid.UNKNOWN and score >= corpus_pipeline.LEAST_SCORE]
    single = one_of_each_group(known)
    clean = [(k, t) for k, t in single if not any(holds(t, i) for i in items)]
    assert len(rows) > len(known) > len(single) > len(clean) > 20

    kept = spark.createDataFrame(clean, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.report(kept, secret_scan.trained(secret_scan.labelled(kept))).collect()}
    want = {}
    for key, text in clean:
        out, at = "", 0
        for start, end in (map(int, s.split(":")[1:]) for s in spans[key].split(",") if s):
            if end > at:
                out += (text[at:start] + "<SECRET>") if start >= at else ""
                at = end
        want[key] = out + text[at:]
    assert want[10_008] == f"{ordered} <SECRET>"

    pieces, got = segmentation.vocabulary(), {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], tuple(r.ids)))
    assert set(got) == set(want)
    for key, found in got.items():
        assert [rank for rank, _ in sorted(found)] == list(range(1, len(found) + 1)) and len({ids for _, ids in found}) == len(found)
        assert {segmentation.decoded(pieces, ids) for _, ids in found} == {want[key]}


def test_run_over_empty_tables(spark, tmp_path):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0) for t in ("documents", "benchmark"))
    assert corpus_pipeline.run(spark, write(spark, tmp_path, docs, bench)).count() == 0

"""Language ID: texts that no table knows, batches, ties, clashing columns; the subpackage's plans."""

from __future__ import annotations

import pytest
from check_oracle import differences, duck
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import common, langid, queries, templates

LABELLED = [("der hund und die katze", "de")] * 3 + [("das haus steht am fluss", "de"), ("the dog and the cat", "en")]
NATIVE = ["op2_secrets", "op6_templates", "op7_licenses"]


@pytest.fixture(scope="module")
def model(spark):
    return langid.trained(spark.createDataFrame(LABELLED, "text string, lang string"))


def test_letters_that_nobody_learned_get_the_commonest_language(spark, model):
    asked = [("日本語の文章",), ("Ωψ",), ("123 !?",), ("",), (None,), ("the dog",), ("der hund",)]
    got = langid.identified(spark.createDataFrame(asked, "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["de", "de", "und", "und", "und", "en", "de"]
    assert [r.score for r in got[:5]] == [0.5, 0.5, 0.0, 0.0, 0.0]


def test_texts_of_a_batch_do_not_touch_each_other(spark, model):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [None, "", "ß", "the " * 50_000]
    one = [langid.predict(text, langid.Rows(model)) for text in docs]
    together = [x for group in langid._in_groups(docs) for x in langid.predicted(group, langid.Rows(model))]
    assert together == one


def test_a_tie_names_the_first_language(spark):
    even = langid.trained(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert langid.predict("same", langid.Rows(even)) == ("a", 0.5)


def test_columns_named_like_the_operators_own(spark, model):
    names = ["_named", "__named", "_held", "_node", "_row", "lang_pred", "score"]
    docs = spark.createDataFrame(
        [(k, text, "de", *[f"{n}{k}" for n in names]) for k, text in enumerate(["der hund und die katze", "das haus steht am fluss"])],
        "doc_id bigint, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    named = langid.identified(docs, model)
    assert [r["_named"] for r in named.orderBy("doc_id").collect()] == ["_named0", "_named1"]
    assert "_held" in common.held(docs, fresh=F.lit(1)).columns
    items = spark.createDataFrame([(1, "which words are these that nobody has ever written")], "item_id bigint, text string")
    kept = templates.decontaminated(docs, items).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    for stage in (corpus_pipeline.known_language, corpus_pipeline.one_of_near_copies):
        out = stage(spark, docs, SMALL).orderBy("doc_id").collect()
        assert [tuple(r) for r in out] == [tuple(r) for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_use_no_python(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.queries()[name](spark, SMALL), duck(SMALL), queries.oracle_sql()[name]) is None

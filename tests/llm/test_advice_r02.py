"""What the second review found cut short: each test failed on the code before it."""

import random

import corpus_pipeline
from ledgerlake.llm import langid, licenses, preferences, secret_scan


def test_common_notices_and_second_licences_keep_their_labels(spark):
    bsd, cc, mit = (licenses.TEMPLATES[k][0] for k in ("bsd", "cc-by", "mit"))
    texts = [bsd] * 20 + [f"plain words number {k}" for k in range(30)] + [f"{cc} . {mit}", f"before {mit} after {bsd} {cc}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scanned(docs).orderBy("doc_id").collect()
    assert {(r.labels, r.score) for r in rows[:20]} == {("bsd", 1.0)}
    assert {(r.labels, r.score) for r in rows[20:50]} == {("", 0.0)}
    assert [r.labels for r in rows[50:]] == ["cc-by,mit", "bsd,cc-by,mit"]
    few = licenses.scanned(docs.filter("doc_id in (0, 50)")).orderBy("doc_id").collect()
    assert [r.labels for r in few] == ["bsd", "cc-by,mit"]


def test_copies_do_not_thin_out_what_is_learned_of_a_language(spark):
    copies = [("ein text", "de")] * 5000 + [(f"wort{chr(97 + k)} haus", "de") for k in range(20)]
    few = [(t, "fr") for t in ("le chat noir", "la maison", "une ville") for _ in range(400)]
    docs = spark.createDataFrame(copies + few, "text string, lang string")
    model = langid.trained(docs, 30)
    ask = spark.createDataFrame([(f"wort{chr(97 + k)}",) for k in range(20)] + [("chat",), ("ville",)], "text string")
    named = {r.text: r.lang_pred for r in langid.identified(ask, model).collect()}
    assert named == {t: "fr" if t in ("chat", "ville") else "de" for t in named}
    # Copies count once: every distinct text is learned from.
    assert "haus" in model.words.entries and "ein" not in model.words.entries


def test_many_labels_neither_shrink_the_model_nor_stop_it(spark):
    def word(k, j):  # no two labels share one
        return chr(0x4E00 + k) + chr(0x4E00 + 1500 + j)

    rows = [(" ".join(word(k, j) for j in range(5)) + tail, f"l{k:04}") for k in range(1200) for tail in ("", " x")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    ask = spark.createDataFrame([(word(k, 4), f"l{k:04}") for k in range(0, 1200, 37)], "text string, lang string")
    for seen in (docs, docs.filter("lang < 'l0900'")):
        named = langid.identified(ask.join(seen.select("lang").distinct().union(
            spark.createDataFrame([("und",)], "lang string")), "lang"), langid.trained(seen)).collect()
        assert len(named) > 20 and all(r.lang_pred == r.lang for r in named)


def test_one_row_of_each_group_stays_and_clean_ones_do(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(3, text, "a"), (3, text, "a"), (3, text, "b"), (None, text, "a"), (7, text + " more", "a"),
            (7, "another clean text of its own", "a"), (None, "a text without number that is repeated", "a"),
            (None, "a text without number that is repeated", "a"), (9, " ", "a"), (9, " ", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(repr(r[:2]) for r in got) == sorted(repr(rows[k][:2]) for k in (0, 5, 6, 8, 9, 10))


def test_different_turns_of_one_number_all_count(spark):
    said = [(1, "c", 1, "user", "q"), (1, "r", 1, "user", "q"), (1, "c", 2, "tool", "call"), (1, "r", 2, "tool", "call"),
            (1, "c", 2, "assistant", "yes"), (1, "c", 2, "assistant", "yes"), (1, "r", 2, "assistant", "no"),
            *((2, side, None, "user", text) for side in "cr" for text in ("a", "b")), (2, "c", None, "user", "c")]
    frame = spark.createDataFrame([(p, {"c": "chosen", "r": "rejected"}[s], *x) for p, s, *x in said],
                                  "pair_id long, side string, turn long, role string, text string")
    one, two = preferences.formatted(frame).orderBy("pair_id").collect()
    # By turn, role and text: the assistant comes before the tool.
    assert one.prompt_turns == 1 and one.chosen == "<|assistant|>\nyes<|end|>\n<|tool|>\ncall<|end|>\n"
    assert one.rejected == "<|assistant|>\nno<|end|>\n<|tool|>\ncall<|end|>\n"
    assert (two.prompt_turns, two.chosen, two.rejected) == (2, "<|user|>\nc<|end|>\n", "")
    talks = [(1, 1, "assistant", "p"), (1, 1, "assistant", "s"), (2, 1, "assistant", "x"), (2, 1, "assistant", "y")]
    talks = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    pair = preferences.formatted(preferences.pairs_of(talks)).filter("pair_id = 2").first()
    # The second of two turns is the last; the conversation before has a second one too.
    assert "y<|end|>" in pair.prompt + pair.chosen and "x<|end|>" in pair.prompt + pair.chosen
    assert "y<|end|>" not in pair.prompt + pair.rejected and "\ns<|end|>" in pair.rejected


def test_secrets_joined_to_words_and_to_base_matches_are_found(spark):
    draw = random.Random(5)
    token = lambda n=32: "".join(draw.choice(secret_scan.ALPHABET[:62]) for _ in range(n))
    words = ["config", "production", "service", "credentials", "request", "handler", "default", "settings"]
    joined = lambda n: "/".join(draw.choice(words) for _ in range(n))
    samples = [(token(), True) for _ in range(400)] + [(joined(5), False) for _ in range(400)]
    models = secret_scan.trained(spark.createDataFrame(samples, "value string, random boolean"))
    one, two, digest = token(), token(), "0123456789abcdef" * 2
    texts = [f"see {joined(9)}/{one}/{joined(9)}/{two} end", f"{digest}_{one}", f"{one}/password=abcdefgh12", joined(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = [r.text for r in secret_scan.redacted(docs, models).orderBy("doc_id").collect()]
    assert all(x[4:-4] not in t for t in left for x in (one, two, digest))
    assert left[3] == texts[3] and left[0].count("<SECRET>") == 2 and left[0].startswith("see ")

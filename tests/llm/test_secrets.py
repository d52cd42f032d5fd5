"""What the secret scan learns from, and columns of any name."""

import random

from ledgerlake.llm import secret_scan


def test_secrets_learn_from_distinct_whole_strings(spark):
    draw = random.Random(2)
    token = lambda n=24: "".join(draw.choice(secret_scan.ALPHABET[:62]) for _ in range(n))
    texts = [f"secret={(same := token())}"] + [f"token={token()}" for _ in range(50)] + [f"password={token(900)}"]
    docs = spark.createDataFrame(list(enumerate(texts + [f"secret={same}"] * 3000)), "doc_id bigint, text string")
    values = [r.value for r in secret_scan.labelled(docs, most=100).collect()]
    assert len(values) == len(set(values)) == 52 and max(map(len, values)) == 900


def test_pairs_of_long_strings_are_all_counted(spark, monkeypatch):
    samples = spark.createDataFrame(
        [("abc_" * 200, False), ("x9Q" * 171, True), ("a", True), ("", True), (None, False)], "value string, random boolean")
    whole = secret_scan.trained(samples).ratios
    monkeypatch.setattr(secret_scan, "PIECE", 100_000)
    assert secret_scan.trained(samples).ratios == whole


def test_secret_columns_named_like_the_operators_own(spark):
    names = ["_held", "_base", "_free", "_spans", "value", "random"]
    text = "password=abcd1234EFGH and more"
    docs = spark.createDataFrame([(1, text, *names), (2, None, *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    models = secret_scan.trained(secret_scan.labelled(docs))
    rows = secret_scan.redacted(docs, models).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in rows] == [tuple(names)] * 2
    assert rows[0].text == "<SECRET> and more" and rows[1].text is None
    assert secret_scan.report(docs, models).count() == 2

"""From documents to token ids: language, near copies, benchmark passages, secrets, segmentation.

Each stage takes what its predecessor kept, as Parquet, and returns the columns of documents;
the last one returns segmentations. Extra columns pass through all stages but the last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import langid, secret_scan, segmentation, superminhash, templates
from ledgerlake.llm.common import durable, shared_folder, spare, table, text_key

LEAST_SCORE = 0.5  # of a language prediction that is believed


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no one language, go."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    named = langid.identified(whole, langid.learn_from(docs))
    return named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that with the least
    doc_id, rows without any last; then by digests of text and of all columns. Of equal rows one
    stays. Blank texts are no copies and all stay."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")), {"ignoreNullFields": "false"})
    node, row = spare("node", docs), spare("row", docs)
    rows = docs.filter(worded).withColumn(node, text_key())
    rows = rows.withColumn(row, F.unhex(F.md5(F.concat(F.col(node), others.cast("binary")))))
    # The best row of each text, then of each group: copies never meet in one task.
    order = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", node, row)
    best = durable(rows.groupBy(F.col(node).alias("node")).agg(F.min(order).alias("best")))
    group = superminhash.families(docs, width=5, percent=80)
    stays = durable(best.join(group, "node").groupBy("root").agg(F.min("best").alias("best")).select(f"best.{row}"))
    one = rows.dropDuplicates([row]).join(stays, row, "left_semi").drop(node, row)
    return one.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter(~worded))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template go."""
    return templates.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced."""
    return secret_scan.redacted(docs, secret_scan.trained(secret_scan.labelled(docs)))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document."""
    return segmentation.segmentations(docs, segmentation.vocabulary())


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("segmentation", segmented),
]

# Trained models and sampled segmentations are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    langid, licenses, pii, preferences, revisits, secret_scan, segmentation, sketches, suffixes, superminhash,
    templates, turnrepair, vectorcodes,
)
from ledgerlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(pairs, "\n"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(docs, secret_scan.trained(secret_scan.labelled(docs)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.trained(docs))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.pairs(table(spark, sf_dir, "conversations"))


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segmentations(table(spark, sf_dir, "documents"), segmentation.vocabulary())


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_copies(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identified(docs.select("doc_id", "text"), langid.learn_from(docs))
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_turnrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.report(table(spark, sf_dir, "conversations"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded(table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
linked AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON a = doc_id
"""


# Bytes as pairs of hexadecimal digits; every string of 50 bytes is looked up as it is.
OP12_SQL = """
WITH bytes AS (
  SELECT doc_id, row_number() OVER () AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, n, p, substring(h, 2 * p + 1, 100) AS s FROM (
    SELECT doc_id, n, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM bytes WHERE len(h) >= 100)),
least AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
gone AS (SELECT n, p FROM strings JOIN least USING (s) WHERE m < doc_id),
begun AS (
  SELECT n, p, CASE WHEN p - lag(p) OVER (PARTITION BY n ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
spans AS (
  SELECT n, min(p) AS a, max(p) + 50 AS e FROM (
    SELECT n, p, sum(new) OVER (PARTITION BY n ORDER BY p) AS span FROM begun) GROUP BY n, span),
removed AS (SELECT n, sum(e - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM spans GROUP BY n)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN h ELSE substring(h, 1, 2 * a[1]) || array_to_string(list_transform(
         range(1, len(a) + 1), lambda i: substring(h, 2 * e[i] + 1, 2 * (coalesce(a[i + 1], len(h)) - e[i]))), '') END)) AS kept_sha256
FROM bytes LEFT JOIN removed USING (n)
"""


def op13_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds: every part is compared with every entry."""
    steps = [f"""
    nearest{r} AS MATERIALIZED (
      SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS best FROM (
        SELECT vec_id, part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d
        FROM x JOIN entries{r} AS c USING (part, pos) GROUP BY vec_id, part, entry)
      GROUP BY vec_id, part),
    entries{r + 1} AS MATERIALIZED (
      SELECT part, entry, pos, coalesce(n.v, e.v) AS v FROM entries{r} AS e LEFT JOIN (
        SELECT part, best.entry AS entry, pos, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v
        FROM x JOIN nearest{r} USING (vec_id, part) GROUP BY ALL) AS n USING (part, entry, pos))""" for r in range(rounds + 1)]
    return f"""
    WITH kept AS (
      SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS MATERIALIZED (
      SELECT vec_id, place, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS pos, v FROM (
        SELECT vec_id, place, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i,
               CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)),
    entries0 AS (SELECT part, place AS entry, pos, v FROM x WHERE place < 256),
    {",".join(steps)},
    coded AS (
      SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
      FROM nearest{rounds} GROUP BY vec_id),
    labelled AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
    SELECT vec_id, code, error, label_error,
           (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM entries{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id) JOIN labelled ON kept.label IS NOT DISTINCT FROM labelled.label
    """


def queries() -> dict[str, Query]:
    return {
        "op1_revisits": op1_revisits,
        "op2_secrets": op2_secrets,
        "op3_pii": op3_pii,
        "op4_preferences": op4_preferences,
        "op5_segmentation": op5_segmentation,
        "op6_templates": op6_templates,
        "op7_licenses": op7_licenses,
        "op8_superminhash": op8_superminhash,
        "op9_sketches": op9_sketches,
        "op10_langid": op10_langid,
        "op11_turnrepair": op11_turnrepair,
        "op12_suffixes": op12_suffixes,
        "op13_vectorcodes": op13_vectorcodes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_superminhash": OP8_SQL,
        "op12_suffixes": OP12_SQL,
        "op13_vectorcodes": op13_sql(),
    }

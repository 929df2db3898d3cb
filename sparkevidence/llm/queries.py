"""Registered queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, classifier, decontam, hardneg, html, langid, licenses, lm, packing, quality_rules, secrets, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@_query("op1_quality_rules", quality_rules.rules_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.score_rules(_table(spark, folder, "documents"))


@_query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op8_simhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op9_license_scans", licenses.scan_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(_table(spark, folder, "documents"))


@_query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontam.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op10_lm_scoring")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document."""
    return lm.score(_table(spark, folder, "documents"))


@_query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, folder, "pages"))


@_query("op4_chat_formatting", chat.RENDER_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render(_table(spark, folder, "conversations"))


@_query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document and every page."""
    return langid.identify(_table(spark, folder, "documents"), _table(spark, folder, "pages"))


HARD_NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same) WHERE place <= 5
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 3
"""


@_query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for the best positives of every fiftieth vector, over all vectors."""
    # Whole from 2^53 on, where floor() would leave the range of long.
    wide = lambda x: 256 * x.cast("double")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.when(F.abs(wide(x)) < 2.0**53, F.floor(wide(x)).cast("double")).otherwise(wide(x)))
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), v.alias("v"))
    return hardneg.mine(rows, F.col("id") % 50 == 0)


@_query("op12_secret_scans")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, also inside nested encodings."""
    return secrets.scan(_table(spark, folder, "documents"))


@_query("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers for every document."""
    vocabulary, model = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, folder, "documents"), vocabulary, model)

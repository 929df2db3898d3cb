"""Reciprocal-rank fusion and lexical reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import terms

RANK_DIGITS = 12


def rrf(*candidate_sets: DataFrame, rank_constant: int = 60, limit: int = 10) -> DataFrame:
    """Fuse candidate sets by the sum of 1 / (rank_constant + rank), scaled by the best sum; a list for each query and index.

    Each fused row keeps its contributions in the order of the sets; a group holds at most one row
    per set, so it is never large.
    """
    if not candidate_sets:
        raise ValueError("a candidate set is needed")
    numbered = [s.withColumn("_set", F.lit(i)) for i, s in enumerate(candidate_sets)]
    rows = numbered[0]
    for other in numbered[1:]:
        rows = rows.unionByName(other)
    contribution = F.struct(
        "_set", "contributor_id", F.col("rank").alias("original_rank"), "safe_score", "candidate_id",
        "element_ids", "locators", "projection",
    )
    fused = rows.groupBy("query_id", "index_id", "document_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rank_constant + F.col("rank"))), RANK_DIGITS).alias("_sum"),
        F.sort_array(F.collect_list(contribution)).alias("contributions"),
    )
    per_query = Window.partitionBy("query_id", "index_id")
    kept = fused.withColumn(
        "rank", F.row_number().over(per_query.orderBy(F.desc("_sum"), "chunk_id"))
    ).filter(F.col("rank") <= limit)
    best = F.max("_sum").over(per_query)
    return kept.withColumn("safe_score", F.when(best > 0, F.col("_sum") / best).otherwise(0.0)).drop("_sum")


def fusion_rejects(*candidate_sets: DataFrame) -> DataFrame:
    """Queries whose sets repeat a contributor or come from different indexes."""
    rows = candidate_sets[0].select("query_id", "contributor_id", "index_id", F.lit(0).alias("_set"))
    for i, other in enumerate(candidate_sets[1:], 1):
        rows = rows.unionByName(other.select("query_id", "contributor_id", "index_id", F.lit(i).alias("_set")))
    seen = rows.groupBy("query_id").agg(
        F.count_distinct("_set").alias("sets"), F.count_distinct("contributor_id").alias("names"),
        F.count_distinct("index_id").alias("indexes"),
    )
    return seen.filter("names < sets OR indexes > 1").select(
        F.lit("query").alias("entity"), F.col("query_id").alias("id"),
        F.when(F.col("indexes") > 1, "one_index").otherwise("distinct_sets").alias("rule"),
        F.lit("FUSION_INPUT_INVALID").alias("code"),
    )


def fusion_metrics(fused: DataFrame, *candidate_sets: DataFrame) -> DataFrame:
    """Per query and index: input sets, input candidates, and inputs minus outputs."""
    rows = None
    for i, one in enumerate(candidate_sets):
        part = one.select("query_id", "index_id", F.lit(i).alias("_set"))
        rows = part if rows is None else rows.unionByName(part)
    keys = ["query_id", "index_id"]
    inputs = rows.groupBy(*keys).agg(
        F.lit(len(candidate_sets)).cast("long").alias("input_sets"), F.count(F.lit(1)).alias("input_candidates")
    )
    outputs = fused.groupBy(*keys).agg(F.count(F.lit(1)).alias("outputs"))
    return inputs.join(outputs, keys, "left").select(
        *keys, "input_sets", "input_candidates",
        (F.col("input_candidates") - F.coalesce("outputs", F.lit(0))).alias("deduplicated"),
    )


def rerank_overlap(fused: DataFrame, queries: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """Every fused row with its overlap score, output rank and reason.

    Score = share of the question's distinct terms found in the chunk, scaled by the best share.
    Rows with reason `included` are the reranked list; they keep their fused score.
    """
    asked = queries.select("query_id", "index_id", F.array_distinct(terms(F.col("text"))).alias("_q"))
    texts = docs.select("index_id", "chunk_id", "keyword_text")
    shared = F.size(F.array_intersect("_q", terms(F.col("keyword_text"))))
    raw = F.when(F.size("_q") > 0, shared / F.size("_q")).otherwise(0.0)
    # Every fused row gets a decision: without its question or text it shares no term.
    held = fused.join(asked, ["query_id", "index_id"], "left").join(texts, ["index_id", "chunk_id"], "left")
    scored = held.withColumn("_raw", F.coalesce(raw, F.lit(0.0)))
    per_query = Window.partitionBy("query_id", "index_id")
    best = F.max("_raw").over(per_query)
    scored = scored.withColumn("rerank_score", F.when(best > 0, F.col("_raw") / best).otherwise(0.0))
    place = F.row_number().over(
        per_query.orderBy(F.desc("rerank_score"), F.col("rank"), F.col("chunk_id"))
    )
    placed = scored.withColumn("_place", place)
    return placed.select(
        *[F.col(c) for c in fused.columns if c != "rank"],
        F.col("rank").alias("input_rank"),
        "rerank_score",
        F.when(F.col("_place") <= limit, F.col("_place")).alias("output_rank"),
        F.when(F.col("_place") <= limit, "included").otherwise("limit_excluded").alias("reason"),
    )


def reranked(decisions: DataFrame) -> DataFrame:
    """The included rows as a ranked list."""
    return decisions.filter("reason = 'included'").withColumnRenamed("output_rank", "rank").drop(
        "input_rank", "rerank_score", "reason"
    )

"""Ranked-retrieval metrics per query case.

Cases: (case_id, ...), with `relevant_ids array<string>` unless the relevant ids come as a long table
(case_id, source_id), which suits cases with very many of them. Inventory: (case_id, source_id, rank,
decision), one row per contributor; `decision` is NULL or 'included' for ranked evidence, anything else
is a diagnostic that never scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import INSUFFICIENT_LABELS, NOT_APPLICABLE, VALUE

# Metric families per ranked stage.
FAMILIES = ("recall", "mrr", "ndcg", "hit")
STAGES = {"retrieval": "retrieval", "fusion": "fusion", "rerank": "rerank"}


def _relevant(cases: DataFrame, relevant: DataFrame | None) -> DataFrame:
    if relevant is None:
        return cases.select("case_id", F.explode(F.array_distinct("relevant_ids")).alias("source_id"))
    return relevant.select("case_id", "source_id").distinct()


def _labelled(cases: DataFrame, relevant: DataFrame) -> DataFrame:
    """Cases with `_n`, the number of their relevant ids."""
    counts = relevant.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    return cases.join(counts, "case_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("int"))


def _selected() -> Column:
    return F.col("decision").isNull() | (F.col("decision") == "included")


def _log2_gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def ranked_metrics(
    cases: DataFrame, inventory: DataFrame, stage: str, k: int = 10, relevant: DataFrame | None = None
) -> DataFrame:
    """Recall@k, MRR, nDCG@k and hit rate: one row per (case, family).

    One pass: hits are counted once per relevant id at its best rank, then every family follows.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    gold = _relevant(cases, relevant)
    best = (
        inventory.filter(_selected() & (F.col("rank") <= k))
        .join(gold, ["case_id", "source_id"])
        .groupBy("case_id", "source_id").agg(F.min("rank").alias("rank"))
        .groupBy("case_id").agg(
            F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"),
            F.sum(_log2_gain(F.col("rank"))).alias("dcg"),
        )
    )
    joined = _labelled(cases, gold).join(best, "case_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("_n")))),
        F.lit(0.0), lambda a, r: a + _log2_gain(r),
    )
    values = {
        "recall": hits / F.col("_n"),
        "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)),
        "ndcg": F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal,
        "hit": F.when(hits > 0, 1.0).otherwise(0.0),
    }
    labelled = F.col("_n") > 0
    family = F.explode(
        F.array(*[
            F.struct(
                F.lit(f"metric.retrieval.{name}.from-{stage}@1").alias("metric_id"),
                F.when(labelled, value).alias("value"),
            )
            for name, value in values.items()
        ])
    )
    kept = [c for c in cases.columns if c != "relevant_ids"]
    return joined.select(
        *kept, F.lit("retrieval").alias("owner"), F.lit(stage).alias("stage_kind"), F.lit(k).alias("k"), "_n",
        hits.alias("_hits"), family.alias("m"),
    ).select(
        *kept, "owner", "stage_kind", "k", "m.metric_id", "m.value",
        F.when(F.col("_n") > 0, VALUE).otherwise(INSUFFICIENT_LABELS).alias("status"),
        F.col("_n").cast("long").alias("labelled_count"), F.col("_hits").cast("long").alias("matched_count"),
        F.col("_n").cast("long").alias("sample_count"),
    )


def context_metrics(cases: DataFrame, inventory: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Precision and recall of the selected evidence; ranks play no part."""
    gold = _relevant(cases, relevant)
    chosen = inventory.filter(_selected())
    counts = chosen.groupBy("case_id").agg(F.count(F.lit(1)).alias("_sel"))
    hits = (
        chosen.join(gold, ["case_id", "source_id"])
        .groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("case_id").agg(F.count(F.lit(1)).alias("_hits"))
    )
    joined = _labelled(cases, gold).join(counts, "case_id", "left").join(hits, "case_id", "left").fillna(0, ["_sel", "_hits"])
    few = F.col("_n") == 0
    rows = F.explode(
        F.array(
            F.struct(
                F.lit("metric.context.precision.from-evidence@1").alias("metric_id"),
                F.when(few, INSUFFICIENT_LABELS).when(F.col("_sel") == 0, NOT_APPLICABLE).otherwise(VALUE).alias("status"),
                (F.col("_hits") / F.when(F.col("_sel") > 0, F.col("_sel"))).alias("value"), F.col("_sel").alias("sample"),
            ),
            F.struct(
                F.lit("metric.context.recall.from-evidence@1").alias("metric_id"),
                F.when(few, INSUFFICIENT_LABELS).otherwise(VALUE).alias("status"),
                (F.col("_hits") / F.when(~few, F.col("_n"))).alias("value"), F.col("_n").cast("long").alias("sample"),
            ),
        )
    )
    kept = [c for c in cases.columns if c != "relevant_ids"]
    valued = F.col("m.status") == VALUE
    return joined.select(*kept, "_hits", rows.alias("m")).select(
        *kept, F.lit("context").alias("owner"), F.lit("context").alias("stage_kind"), "m.metric_id", "m.status",
        F.when(valued, F.col("m.value")).alias("value"),
        F.when(valued, F.col("m.sample")).otherwise(0).alias("labelled_count"),
        F.when(valued, F.col("_hits")).otherwise(0).alias("matched_count"),
        F.when(valued, F.col("m.sample")).otherwise(0).alias("sample_count"),
    )


def metric_matches(cases: DataFrame, inventory: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """The diagnostic inventory: every row with its relevance, one long table."""
    gold = _relevant(cases, relevant).withColumn("_r", F.lit(True))
    return inventory.join(gold, ["case_id", "source_id"], "left").withColumn(
        "relevant", F.coalesce("_r", F.lit(False))
    ).drop("_r")


def ranked_inventory(candidates: DataFrame, source_id: Column, stage: str) -> DataFrame:
    """Inventory rows of a ranked stage: fused and reranked rows give one per contribution."""
    decision = F.lit("included" if stage == "rerank" else None).cast("string")
    if "contributions" in candidates.columns:
        rows = candidates.withColumn("_who", F.explode(F.transform("contributions", lambda c: c["contributor_id"])))
    else:
        rows = candidates.withColumn("_who", F.col("contributor_id"))
    return rows.select(
        F.col("query_id").alias("case_id"), source_id.alias("source_id"), "rank", F.col("_who").alias("contributor_id"),
        decision.alias("decision"),
    )

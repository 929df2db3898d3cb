"""Golden datasets, stage tables and plan snapshots on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import digest
from ..operators.rules import case_digest, rejects

# The closed set of stage tables this package writes.
STAGES = (
    "sources", "elements", "tables", "table_cells", "chunks", "embeddings", "search_documents", "postings",
    "doc_lengths", "candidates", "fused", "reranked", "evidence_items", "context_decisions", "evidence_shortage",
    "answers", "verifications", "final_responses", "annotations", "query_cases", "reviews", "dataset_revisions",
    "metric_reports", "metric_matches", "metric_aggregates", "judge_labels", "judge_results", "calibration_report",
    "gate_results", "failed_cases", "comparison_pairs", "runs", "stage_attempts", "artifacts", "lineage", "rejects",
)


def read_dataset(spark: SparkSession, path: str, schema, content: Sequence[str], case_id: str = "case_id") -> DataFrame:
    """Cases from JSON lines; reviews that did not see exactly this content are stripped.

    Each row carries `reviews array<struct<reviewer, reviewed_at, content_digest>>`.
    """
    return strip_reviews(spark.read.schema(schema).option("mode", "FAILFAST").json(path), content)


def strip_reviews(cases: DataFrame, content: Sequence[str]) -> DataFrame:
    now = case_digest(F.struct(*content))
    return cases.withColumn("_now", now).withColumn(
        "reviews", F.filter("reviews", lambda r: r["content_digest"] == F.col("_now"))
    ).drop("_now")


def export_dataset(cases: DataFrame, path: str, order: str = "case_id") -> None:
    """Canonical export: fields in name order, rows in id order within range-partitioned files."""
    columns = sorted(cases.columns)
    cases.select(*columns).repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").json(path)


def create_revision(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number incoming dataset contents after their latest revision.

    Existing: (dataset_id, revision, taxonomy_digest, ...); incoming: (dataset_id, taxonomy_digest,
    content_digest, ...), one per dataset. Returns (rows to append, rejects); a revision must keep
    its parent's taxonomy.
    """
    latest = existing.groupBy("dataset_id").agg(
        F.max("revision").alias("_parent"), F.max_by("taxonomy_digest", "revision").alias("_taxonomy")
    )
    joined = incoming.join(latest, "dataset_id", "left")
    ok = F.col("_taxonomy").isNull() | (F.col("_taxonomy") == F.col("taxonomy_digest"))
    rows = joined.filter(ok).select(
        *incoming.columns, (F.coalesce("_parent", F.lit(0)) + 1).cast("int").alias("revision"),
        F.col("_parent").alias("parent_revision"),
    )
    return rows, rejects(joined.filter(~ok), "dataset", F.col("dataset_id"), "taxonomy_changed", "DATASET_INVALID")


def write_stage(df: DataFrame, name: str, root: str, partition_by: Sequence[str] = ("index_id",), mode: str = "append") -> None:
    """Append a stage table below `root`; only the known names exist."""
    if name not in STAGES:
        raise ValueError(f"unknown stage table {name}")
    writer = df.write.mode(mode)
    keys = [c for c in partition_by if c in df.columns]
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}")


def read_stage(spark: SparkSession, name: str, root: str) -> DataFrame:
    if name not in STAGES:
        raise ValueError(f"unknown stage table {name}")
    return spark.read.parquet(f"{root}/{name}")


def snapshot_parents(cases: DataFrame, errors: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a dataset snapshot pins: (distinct source and evidence ids, cases that block it).

    The snapshot may be published only while the second frame is empty.
    """
    flawed = cases.select("case_id").join(
        errors.filter(F.size("errors") > 0).select("case_id"), "case_id", "left_semi"
    )
    fresh = cases.select("case_id").join(reviewed.filter("is_reviewed").select("case_id"), "case_id", "left_anti")
    blocking = rejects(flawed, "case", F.col("case_id"), "invalid", "DATASET_INVALID").unionByName(
        rejects(fresh, "case", F.col("case_id"), "unreviewed", "DATASET_INVALID")
    )
    parents = cases.select(F.explode(F.array_compact(F.array("source_id", "evidence_id"))).alias("artifact_id")).distinct()
    return parents, blocking


def plan_digest(plan: Column) -> Column:
    """Digest of a plan given as sorted-key JSON text or as a struct with alphabetical fields."""
    return digest(plan)


def plan_snapshots(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per plan digest, and digests under which different plans were stored.

    Plans: (plan_digest, plan_json).
    """
    seen = plans.groupBy("plan_digest").agg(
        F.min("plan_json").alias("plan_json"), F.max("plan_json").alias("_other"), F.count(F.lit(1)).alias("uses")
    )
    same = seen.filter("plan_json = _other").drop("_other")
    return same, rejects(seen.filter("plan_json <> _other"), "plan", F.col("plan_digest"), "plan_conflict", "PLAN_INVALID")

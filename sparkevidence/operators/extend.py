"""User-supplied parts: each is a callable whose output passes the same checks as the built-in.

The output is staged first, so user code runs once and the rows returned are those that were checked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .rules import check_candidates, check_embeddings

MetricFn = Callable[[DataFrame, DataFrame], DataFrame]


class RejectedOutput(ValueError):
    """A user-supplied part returned rows that break a rule."""


def _require_none(found: DataFrame, what: str) -> None:
    first = found.take(1)
    if first:
        raise RejectedOutput(f"{what}: {first[0]['rule']} ({first[0]['id']})")


def embed(df: DataFrame, fn: Callable[[str], Sequence[float]], dimension: int, text: str = "content",
          key: str = "chunk_id", check: bool = True) -> DataFrame:
    """(key, embedding) from a text-to-vector function, run on Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in fn(t)])

    out = df.select(F.col(key).alias("chunk_id"), run(F.col(text)).alias("embedding"))
    if check:
        out = materialize(out, "user-embeddings")
        _require_none(check_embeddings(out, dimension), "embedding")
    return out if key == "chunk_id" else out.withColumnRenamed("chunk_id", key)


def retrieve(fn: Callable[[DataFrame, DataFrame], DataFrame], docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates from a user retriever or hybrid search."""
    out = materialize(fn(docs, queries), "user-candidates")
    _require_none(check_candidates(out, docs), "retriever")
    return out


def fuse(fn: Callable[..., DataFrame], *candidate_sets: DataFrame) -> DataFrame:
    """Fused rows must rank 1..n per query and index, and name only chunks of their inputs."""
    out = materialize(fn(*candidate_sets), "user-fused")
    keys = ["query_id", "index_id", "chunk_id"]
    inputs = candidate_sets[0].select(*keys)
    for one in candidate_sets[1:]:
        inputs = inputs.unionByName(one.select(*keys))
    foreign = out.select(*keys).join(inputs.distinct(), keys, "left_anti")
    _require_none(foreign.select(F.col("chunk_id").alias("id"), F.lit("foreign_chunk").alias("rule")), "fusion")
    _require_none(_rank_gaps(out, F.col("rank")), "fusion")
    return out


def rerank(fn: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], fused: DataFrame, queries: DataFrame,
           docs: DataFrame) -> DataFrame:
    """Decisions must cover every fused row once."""
    out = materialize(fn(fused, queries, docs), "user-decisions")
    keys = ["query_id", "index_id", "chunk_id"]
    counted = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    gaps = fused.select(*keys).join(counted, keys, "full").filter("n IS NULL OR n <> 1").select(
        F.col("chunk_id").alias("id"), F.lit("decision_complete").alias("rule")
    )
    _require_none(gaps, "reranker")
    _require_none(_rank_gaps(out.filter("output_rank IS NOT NULL"), F.col("output_rank")), "reranker")
    return out


def assemble(fn: Callable[[DataFrame, DataFrame], DataFrame], candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Selected evidence must be unique per query and index, and quote its chunk."""
    out = materialize(fn(candidates, docs), "user-evidence")
    chosen = out.filter("selected")
    twice = chosen.groupBy("query_id", "index_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("chunk_id").alias("id"), F.lit("unique_evidence").alias("rule")
    )
    quoted = chosen.join(docs.select("index_id", "chunk_id", "keyword_text"), ["index_id", "chunk_id"], "left").filter(
        ~F.coalesce(F.startswith("keyword_text", F.col("excerpt")), F.lit(False))
    ).select(F.col("chunk_id").alias("id"), F.lit("excerpt_of_chunk").alias("rule"))
    _require_none(twice.unionByName(quoted), "context")
    return out


def _rank_gaps(df: DataFrame, rank: Column) -> DataFrame:
    seen = df.groupBy("query_id", "index_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(rank).alias("d"), F.min(rank).alias("lo"), F.max(rank).alias("hi")
    )
    return seen.filter("d <> n OR lo <> 1 OR hi <> n").select(F.col("query_id").alias("id"), F.lit("ranks").alias("rule"))


class MetricRegistry:
    """Metrics by id; each maps (labels, observed) to report rows."""

    REQUIRED = ("metric_id", "status", "value")

    def __init__(self) -> None:
        self._metrics: dict[str, MetricFn] = {}

    def register(self, metric_id: str, fn: MetricFn) -> None:
        if metric_id in self._metrics:
            raise ValueError(f"metric {metric_id} is registered already")
        self._metrics[metric_id] = fn

    def ids(self) -> list[str]:
        return sorted(self._metrics)

    def run(self, metric_id: str, labels: DataFrame, observed: DataFrame) -> DataFrame:
        if metric_id not in self._metrics:
            raise KeyError(f"metric {metric_id} is not registered")
        out = self._metrics[metric_id](labels, observed)
        missing = [c for c in self.REQUIRED if c not in out.columns]
        if missing:
            raise RejectedOutput(f"{metric_id} lacks {missing}")
        return out

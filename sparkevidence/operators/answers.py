"""Answer verification, attempt selection, final states and decision paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import stable_id
from ..functions.text import content_tokens, sentences

# User-facing actions.
ACTION_NO_GENERATION = "Retry the configured query after generation is available."
ACTION_RETRY = "Provide more evidence or retry the configured query."


@dataclass(frozen=True)
class VerifyConfig:
    minimum_items: int = 1
    forbidden_phrases: Sequence[str] = ()


def verify_answers(
    answers: DataFrame, evidence: DataFrame, config: VerifyConfig = VerifyConfig()
) -> DataFrame:
    """Failure codes and outcome of every answer attempt.

    `answers`: (query_id, attempt, answer, citation_keys, answerability); `evidence`: one row per
    item (query_id, citation_key, excerpt). A query's evidence is bounded by the context budget.
    """
    items = evidence.groupBy("query_id").agg(
        F.collect_list(F.struct("citation_key", content_tokens(F.col("excerpt")).alias("words"))).alias("_items")
    )
    joined = answers.join(items, "query_id", "left").withColumn(
        "_items", F.coalesce("_items", F.array().cast("array<struct<citation_key:string,words:array<string>>>"))
    )
    keys = F.transform("_items", lambda i: i["citation_key"])
    cited = F.filter("_items", lambda i: F.array_contains(F.col("citation_keys"), i["citation_key"]))
    ready = joined.select(
        *answers.columns,
        F.size("_items").alias("_n"),
        F.filter("citation_keys", lambda k: ~F.array_contains(keys, k)).alias("missing_citation_keys"),
        F.filter("citation_keys", lambda k: F.array_contains(keys, k)).alias("resolved_citation_keys"),
        F.size(cited).alias("_cited"),
        F.array_distinct(F.flatten(F.transform(cited, lambda i: i["words"]))).alias("_words"),
        F.filter(
            F.transform(sentences(F.col("answer")), lambda s: content_tokens(s)), lambda w: F.size(w) > 0
        ).alias("_said"),
    )
    forbidden = F.lit(False)
    for phrase in config.forbidden_phrases:
        forbidden = forbidden | F.contains(F.lower("answer"), F.lit(phrase.lower()))
    unsupported = (F.col("_cited") > 0) & F.exists("_said", lambda w: ~F.arrays_overlap(w, F.col("_words")))
    insufficient = F.col("_n") < config.minimum_items
    codes = F.array_compact(
        F.array(
            F.when(insufficient, "INSUFFICIENT_EVIDENCE"),
            F.when(F.size("missing_citation_keys") > 0, "UNKNOWN_CITATION"),
            F.when(forbidden, "FORBIDDEN_CONTENT"),
            F.when(unsupported, "UNSUPPORTED_CONTENT"),
        )
    )
    asked = F.col("answerability")
    extra = F.array_compact(
        F.array(F.when(asked == "ambiguous", "AMBIGUOUS_QUESTION"), F.when(asked == "not_answerable", "NOT_ANSWERABLE"))
    )
    outcome = (
        F.when(asked == "ambiguous", "clarification_required")
        .when(asked == "not_answerable", "abstain")
        .when(insufficient, "abstain")
        .when(F.size("_codes") > 0, "repairable")
        .otherwise("pass")
    )
    return (
        ready.withColumn("_codes", codes)
        .withColumn("outcome", outcome)
        .withColumn("failure_codes", F.concat("_codes", extra))
        .withColumn("answerable", F.col("outcome") == "pass")
        .withColumn("verification_id", stable_id("ver", "query_id", "attempt", "outcome", F.array_join("failure_codes", ",")))
        .select(
            *answers.columns, "verification_id", "outcome", "failure_codes", "resolved_citation_keys",
            "missing_citation_keys", "answerable",
        )
    )


def select_attempt(verifications: DataFrame, max_repairs: int = 2) -> DataFrame:
    """The first attempt that is not repairable within the repair bound, else the last one tried."""
    tried = verifications.filter(F.col("attempt") <= 1 + max_repairs)
    chosen = tried.groupBy("query_id").agg(
        F.min(F.when(F.col("outcome") != "repairable", F.col("attempt"))).alias("_done"),
        F.max("attempt").alias("_last"),
    )
    pick = chosen.select("query_id", F.coalesce("_done", "_last").alias("attempt"))
    return tried.join(pick, ["query_id", "attempt"])


def final_state(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """One response per query; only a passed verification carries an answer."""
    joined = queries.select("query_id").join(selected, "query_id", "left")
    outcome = F.col("outcome")
    passed = F.coalesce(outcome == "pass", F.lit(False))
    state = (
        F.when(outcome == "pass", "ANSWERED")
        .when(outcome == "clarification_required", "CLARIFICATION_REQUIRED")
        .when(outcome == "abstain", "ABSTAINED")
        .otherwise("FAILED")
    )
    action = F.when(passed, F.lit(None).cast("string")).when(outcome.isNull(), F.lit(ACTION_NO_GENERATION)).otherwise(
        F.lit(ACTION_RETRY)
    )
    return joined.select(
        "query_id", "attempt", state.alias("state"), F.when(passed, F.col("answer")).alias("answer"),
        F.when(passed, F.col("citation_keys")).otherwise(F.array().cast("array<string>")).alias("citation_keys"),
        action.alias("action"),
    )


def answer_visibility(final: DataFrame, evidence: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Show an answer only when its run is bound to its index and it cites nothing but its evidence."""
    keys = evidence.groupBy("query_id").agg(F.collect_set("citation_key").alias("_keys"))
    joined = final.join(keys, "query_id", "left")
    known = F.size(F.array_except("citation_keys", F.coalesce("_keys", F.array().cast("array<string>")))) == 0
    if bound is not None:
        joined = joined.join(bound.select("query_id", F.lit(True).alias("_bound")), "query_id", "left")
        known = known & F.coalesce("_bound", F.lit(False))
    answered = F.col("state") == "ANSWERED"
    valid = answered & known & (F.length(F.coalesce("answer", F.lit(""))) > 0)
    return joined.select(
        "query_id", "state", F.when(answered, valid).otherwise(F.lit(True)).alias("available"),
        F.when(valid, F.col("answer")).alias("answer"),
        F.when(valid, F.col("citation_keys")).otherwise(F.array().cast("array<string>")).alias("citation_keys"),
    )


def decision_path(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (query, document, chunk) with one column per stage.

    Each stage frame has (query_id, document_id, chunk_id, rank, decision); stages are in order, and
    rows keep the order in which a chunk was first seen. The last decision of a stage counts.
    """
    rows = None
    for number, (name, frame) in enumerate(stages.items()):
        part = frame.select(
            "query_id", "document_id", "chunk_id", F.lit(name).alias("_stage"),
            F.lit(number).alias("_no"), F.col("rank").cast("long").alias("rank"), "decision",
        )
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy("query_id", "document_id", "chunk_id").agg(
        F.min(F.struct("_no", "rank")).alias("_first"),
        *[F.max_by("decision", F.when(F.col("_stage") == n, F.col("rank"))).alias(f"_{n}") for n in stages],
        *[F.count_if(F.col("_stage") == n).alias(f"_has_{n}") for n in stages],
    )
    order = Window.partitionBy("query_id").orderBy("_first._no", "_first.rank", "document_id", "chunk_id")
    return wide.select(
        "query_id", "document_id", "chunk_id", F.row_number().over(order).alias("position"),
        *[
            F.when(F.col(f"_has_{n}") > 0, F.col(f"_{n}")).otherwise(F.lit("NOT_PRESENT")).alias(n)
            for n in stages
        ],
    )

"""Fact, citation, decision and judge metrics per query case and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normal import fact_spans, fold_fact
from .quality import INSUFFICIENT_LABELS, NOT_APPLICABLE, VALUE

# Metric ids, decision families, the form of a citation key.
FACT_COVERAGE = "metric.answer.expected-fact-coverage@1"
FACT_VIOLATION = "metric.answer.forbidden-fact-violation@1"
CITATION_PRECISION = "metric.citation.precision@1"
CITATION_RECALL = "metric.citation.recall@1"
DECISIONS = {
    "answerability": ("answerable", "ANSWERED"),
    "ambiguity": ("ambiguous", "CLARIFICATION_REQUIRED"),
    "abstention": ("unanswerable", "ABSTAINED"),
}
CITATION_KEY = "^cit_[a-f0-9]{32}$"


def fact_labels(cases: DataFrame, facts: str, fold: str = "compatible") -> DataFrame:
    """Distinct folded facts per case: (case_id, fact)."""
    return cases.select("case_id", F.explode(facts).alias("_f")).select(
        "case_id", fold_fact(F.col("_f"), fold).alias("fact")
    ).distinct()


def fact_matches(cases: DataFrame, answers: DataFrame, facts: str, fold: str = "compatible") -> DataFrame:
    """Every occurrence of every labelled fact, with its span in the original answer."""
    spans = fact_labels(cases, facts, fold).join(answers.select("case_id", "answer"), "case_id").select(
        "case_id", F.concat(F.lit("fact:"), F.substring(F.sha2("fact", 256), 1, 32)).alias("source_id"),
        F.explode(fact_spans(F.col("answer"), F.col("fact"), fold)).alias("s"),
    )
    return spans.select("case_id", "source_id", F.lit(True).alias("relevant"), "s.span_start", "s.span_end")


def fact_metric(cases: DataFrame, answers: DataFrame, expected: bool = True, fold: str = "compatible") -> DataFrame:
    """Share of distinct labelled facts found in the answer, both folded as `fold` says (see functions.normal).

    Expected facts score answerable cases only; forbidden ones are better the lower they are.
    """
    facts = "expected_facts" if expected else "forbidden_facts"
    labels = fact_labels(cases, facts, fold).groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    found = fact_matches(cases, answers, facts, fold).groupBy("case_id").agg(
        F.count_distinct("source_id").alias("_m")
    )
    scored = answers.select("case_id").distinct().join(cases, "case_id").join(labels, "case_id", "left").join(
        found, "case_id", "left"
    ).fillna(0, ["_n", "_m"])
    none = F.lit(INSUFFICIENT_LABELS if expected else NOT_APPLICABLE)
    status = F.when(F.col("_n") == 0, none).otherwise(VALUE)
    if expected:
        status = F.when(F.col("answerability") != "answerable", NOT_APPLICABLE).otherwise(status)
    return _case_report(
        scored.withColumn("status", status), FACT_COVERAGE if expected else FACT_VIOLATION, "answer",
        F.col("_m") / F.when(F.col("_n") > 0, F.col("_n")), F.col("_n"), F.col("_m"),
        "higher_is_better" if expected else "lower_is_better",
    )


def _case_report(rows: DataFrame, metric: str, owner: str, value: Column, labelled: Column, matched: Column,
                 direction: str = "higher_is_better") -> DataFrame:
    valued = F.col("status") == VALUE
    return rows.select(
        "case_id", F.lit(metric).alias("metric_id"), F.lit(owner).alias("owner"), F.lit(direction).alias("direction"),
        "status", F.when(valued, value).alias("value"),
        F.when(valued, labelled).otherwise(0).cast("long").alias("labelled_count"),
        F.when(valued, matched).otherwise(0).cast("long").alias("matched_count"),
    )


def citation_matches(answers: DataFrame, evidence: DataFrame, verifications: DataFrame) -> DataFrame:
    """One row per generated key, duplicates and malformed ones included.

    A key is relevant when the evidence holds it and the verification resolved it.
    """
    generated = answers.select("case_id", F.posexplode("citation_keys").alias("position", "citation_key"))
    held = evidence.select(F.col("query_id").alias("case_id"), "citation_key").distinct().withColumn("_held", F.lit(True))
    checked = verifications.select("case_id", "resolved_citation_keys", "missing_citation_keys")
    rows = generated.join(held, ["case_id", "citation_key"], "left").join(checked, "case_id", "left")
    formed = F.coalesce(F.col("citation_key").rlike(CITATION_KEY), F.lit(False))
    resolved = F.coalesce(F.array_contains("resolved_citation_keys", F.col("citation_key")), F.lit(False))
    missing = F.coalesce(F.array_contains("missing_citation_keys", F.col("citation_key")), F.lit(False))
    return rows.select(
        "case_id", "position", "citation_key",
        (formed & resolved & ~missing & F.coalesce("_held", F.lit(False))).alias("relevant"),
        F.when(~formed, "malformed").when(resolved, "resolved").otherwise("unsupported").alias("decision_id"),
    )


def missing_citations(cases: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Required keys that the answer does not validly cite, as match rows with the decision `missing`."""
    required = cases.join(answers.select("case_id").distinct(), "case_id").select(
        "case_id", F.explode(F.array_distinct("required_citation_keys")).alias("citation_key")
    )
    valid = matches.filter("relevant").select("case_id", "citation_key").distinct()
    return required.join(valid, ["case_id", "citation_key"], "left_anti").select(
        "case_id", F.lit(None).cast("int").alias("position"), "citation_key", F.lit(False).alias("relevant"),
        F.lit("missing").alias("decision_id"),
    )


def citation_precision(cases: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Valid over generated keys; cases without required keys have too few labels."""
    counts = matches.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("relevant").alias("_m")
    )
    rows = answers.select("case_id").distinct().join(cases, "case_id").join(counts, "case_id", "left").fillna(
        0, ["_n", "_m"]
    )
    status = F.when(F.size("required_citation_keys") == 0, INSUFFICIENT_LABELS).otherwise(VALUE)
    value = F.when(F.col("_n") > 0, F.col("_m") / F.col("_n")).otherwise(0.0)
    return _case_report(rows.withColumn("status", status), CITATION_PRECISION, "citation", value, F.col("_n"), F.col("_m"))


def citation_recall(cases: DataFrame, answers: DataFrame, matches: DataFrame) -> DataFrame:
    """Required keys that were validly cited, with the missing ones listed in order."""
    valid = matches.filter("relevant").groupBy("case_id").agg(F.collect_set("citation_key").alias("_valid"))
    rows = answers.select("case_id").distinct().join(cases, "case_id").join(valid, "case_id", "left")
    required = F.array_distinct("required_citation_keys")
    known = F.coalesce("_valid", F.array().cast("array<string>"))
    rows = rows.withColumn("_n", F.size(required)).withColumn("_m", F.size(F.array_intersect(required, known)))
    status = F.when(F.col("_n") == 0, INSUFFICIENT_LABELS).otherwise(VALUE)
    rows = rows.withColumn("status", status).withColumn(
        "missing_keys", F.array_sort(F.array_except(required, known))
    )
    report = _case_report(
        rows, CITATION_RECALL, "citation", F.col("_m") / F.when(F.col("_n") > 0, F.col("_n")), F.col("_n"), F.col("_m")
    )
    return report.join(rows.select("case_id", "missing_keys"), "case_id")


def decision_metrics(cases: DataFrame, final: DataFrame) -> DataFrame:
    """Six rows per case: precision and recall of answering, clarifying and abstaining.

    Cases: (case_id, answerability, ...); final: (query_id, state). Undefined precision does not
    apply, undefined recall lacks labels.
    """
    states = final.select(F.col("query_id").alias("case_id"), "state")
    joined = cases.join(states, "case_id")
    rows = []
    for family, (label, state) in DECISIONS.items():
        expected, predicted = F.col("answerability") == label, F.col("state") == state
        outcome = F.when(expected & predicted, "TP").when(predicted, "FP").when(expected, "FN").otherwise("TN")
        for measure, base, undefined in (
            ("precision", predicted, NOT_APPLICABLE), ("recall", expected, INSUFFICIENT_LABELS)
        ):
            rows.append(
                F.struct(
                    F.lit(f"metric.decision.{family}-{measure}@1").alias("metric_id"),
                    F.when(base, VALUE).otherwise(F.lit(undefined)).alias("status"),
                    F.when(base, (expected & predicted).cast("double")).alias("value"),
                    base.cast("long").alias("labelled_count"),
                    (expected & predicted).cast("long").alias("matched_count"), outcome.alias("decision_id"),
                )
            )
    return joined.select(*cases.columns, F.explode(F.array(*rows)).alias("m")).select(
        *cases.columns, F.lit("decision").alias("owner"), "m.*"
    )


def judge_metric(labels: DataFrame, results: DataFrame, positive: str, report: DataFrame | None = None) -> DataFrame:
    """Judge verdict as a metric, with its eligibility.

    Labels and results share `case_id` and pins (snapshot_id, definition_id, definition_digest,
    evidence_digest). Without a calibration report the row is ADVISORY; any differing pin is
    DRIFTED; else the report's eligibility counts.
    """
    pins = ["snapshot_id", "definition_id", "definition_digest", "evidence_digest"]
    joined = labels.alias("l").join(results.alias("r"), F.col("l.case_id") == F.col("r.case_id")).select(
        F.col("l.case_id").alias("case_id"), F.col("r.label").alias("_label"),
        *[(~F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))).alias(f"_d_{p}") for p in pins],
        *[F.col(f"r.{p}").alias(p) for p in pins],
    )
    drift = F.lit(False)
    for p in pins:
        drift = drift | F.col(f"_d_{p}")
    if report is None:
        eligibility = F.when(drift, "DRIFTED").otherwise("ADVISORY")
        rows = joined
    else:
        known = report.select("definition_id", *[
            F.col(c).alias(f"_r_{c}") for c in ("snapshot_id", "definition_digest", "eligibility")
        ])
        rows = joined.join(known, "definition_id", "left")
        stale = (F.col("_r_snapshot_id") != F.col("snapshot_id")) | (
            F.col("_r_definition_digest") != F.col("definition_digest")
        )
        eligibility = (
            F.when(drift, "DRIFTED").when(F.col("_r_eligibility").isNull(), "ADVISORY").when(stale, "DRIFTED")
            .otherwise(F.col("_r_eligibility"))
        )
    hit = F.col("_label") == positive
    return rows.select(
        "case_id", F.lit("judge").alias("owner"), F.lit(VALUE).alias("status"), hit.cast("double").alias("value"),
        F.lit(1).cast("long").alias("labelled_count"), hit.cast("long").alias("matched_count"),
        eligibility.alias("eligibility"),
    )

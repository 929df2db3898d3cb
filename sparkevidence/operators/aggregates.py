"""Slice aggregates, judge calibration, quality gates and their guards.

Reports: (report_id, metric_id, owner, stage_kind, case_id, document_id, slices struct, status,
value, sample_count[, eligibility, decision_id, ...]). Member lists stay long tables, because one
slice may hold a large share of all reports.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import stable_id
from ..schemas import SLICES
from .quality import INSUFFICIENT_LABELS, NOT_APPLICABLE, VALUE

# Which match decisions count as a failure of which kind.
FAILURES = {
    "unsupported_fact": ("unsupported", "unsupported_content"),
    "invalid_citation": ("malformed", "missing", "unsupported"),
}
LAYERS = ("ingestion", "retrieval", "answer", "citation", "decision", "judge", "latency", "resources")


def aggregate_id() -> Column:
    return stable_id("agg", "metric_id", "owner", F.to_json("slices"))


def aggregate_metrics(reports: DataFrame) -> DataFrame:
    """One row per metric and slice vector; the mean covers VALUE rows only."""
    sample = F.col("sample_count") if "sample_count" in reports.columns else F.lit(None).cast("long")
    eligible = F.col("eligibility") if "eligibility" in reports.columns else F.lit(None).cast("string")
    return reports.groupBy("metric_id", "owner", "slices").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.col("status") == VALUE).alias("scored_count"),
        F.count_if(F.col("status") == NOT_APPLICABLE).alias("not_applicable_count"),
        F.count_if(F.col("status") == INSUFFICIENT_LABELS).alias("insufficient_labels_count"),
        F.avg(F.when(F.col("status") == VALUE, F.col("value"))).alias("value"),
        F.sum(F.when(F.col("owner") != "ingestion", F.coalesce(sample, F.lit(0)))).alias("sample_count"),
        F.count_if(eligible == "ADVISORY").alias("advisory_count"),
        F.count_if(eligible == "INELIGIBLE").alias("ineligible_count"),
        F.count_if(eligible == "DRIFTED").alias("drifted_count"),
    ).withColumn("aggregate_id", aggregate_id())


def aggregate_members(reports: DataFrame) -> DataFrame:
    """The report ids behind each aggregate, one per row."""
    return reports.select(aggregate_id().alias("aggregate_id"), "report_id")


def aggregate_decisions(reports: DataFrame, by: Sequence[str] = ("metric_id",)) -> DataFrame:
    """Micro precision or recall over a cohort: TP / (TP + FP) or TP / (TP + FN)."""
    counts = reports.groupBy(*by).agg(
        *[F.count_if(F.col("decision_id") == d).alias(d.lower()) for d in ("TP", "FP", "FN", "TN")],
        F.count(F.lit(1)).alias("case_count"),
    )
    precision = F.col("metric_id").endswith("-precision@1")
    base = F.col("tp") + F.when(precision, F.col("fp")).otherwise(F.col("fn"))
    return counts.withColumn("sample_count", base).withColumn("value", F.col("tp") / F.when(base > 0, base))


def cohort_rejects(reports: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cases missing from, or foreign to, the configured cohort (metric_id, case_id)."""
    have = reports.select("metric_id", "case_id").distinct()
    missing = cohort.join(have, ["metric_id", "case_id"], "left_anti").withColumn("rule", F.lit("cohort_missing"))
    foreign = have.join(cohort, ["metric_id", "case_id"], "left_anti").withColumn("rule", F.lit("cohort_foreign"))
    return missing.unionByName(foreign).select(
        F.lit("aggregate").alias("entity"), F.concat_ws("/", "metric_id", "case_id").alias("id"), "rule",
        F.lit("COHORT_INVALID").alias("code"),
    )


def aggregate_guard(reports: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that must not be aggregated, with the rule they break."""
    identity = F.struct(*[
        c for c in ("owner", "stage_kind", "metric_family_id", "cohort_digest", "judge_definition_digest")
        if c in reports.columns
    ])
    taxonomy = F.col("taxonomy_digest") if "taxonomy_digest" in reports.columns else F.lit("")
    key = F.when(F.col("owner") == "ingestion", F.struct(F.col("document_id").alias("a"), F.lit("").alias("b"))) \
        .otherwise(F.struct(F.col("case_id").alias("a"), F.coalesce("stage_kind", F.lit("")).alias("b")))
    # First per key, so that a large group is combined before its distinct counts.
    keyed = reports.groupBy(*group, key.alias("_k"), F.col("metric_id").alias("_m"), taxonomy.alias("_t"),
                            identity.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    seen = keyed.groupBy(*group).agg(
        F.min("_m").alias("m0"), F.max("_m").alias("m1"), F.min("_t").alias("t0"), F.max("_t").alias("t1"),
        F.min(F.to_json("_i")).alias("i0"), F.max(F.to_json("_i")).alias("i1"), F.max("_n").alias("n"),
    )
    rule = F.explode(F.array_compact(F.array(
        F.when(F.col("m0") != F.col("m1"), "mixed_metric"), F.when(F.col("t0") != F.col("t1"), "mixed_taxonomy"),
        F.when(F.col("i0") != F.col("i1"), "mixed_identity"), F.when(F.col("n") > 1, "duplicate_report"),
    )))
    return seen.select(*group, rule.alias("rule"))


# ---------------------------------------------------------------- judge calibration


@dataclass(frozen=True)
class SlicePolicy:
    selector: Mapping[str, str] = field(default_factory=dict)
    minimum_samples: int = 1
    minimum_agreement: float = 0.0
    maximum_false_positive_rate: float = 1.0
    maximum_false_negative_rate: float = 1.0

    def matches(self) -> Column:
        test = F.lit(True)
        for dimension, value in self.selector.items():
            if dimension not in SLICES:
                raise ValueError(f"unknown slice dimension {dimension}")
            test = test & F.coalesce(F.col("slices")[dimension] == value, F.lit(False))
        return test

    @property
    def name(self) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(self.selector.items())) or "overall"


def calibrate(
    labels: DataFrame, results: DataFrame, positive: str, policies: Sequence[SlicePolicy]
) -> DataFrame:
    """Agreement and error rates per policy slice and overall.

    Labels: (case_id, label, slices); results: (case_id, label). A slice is eligible when every
    label has a result and its policy holds; the overall row also needs every slice to be eligible.
    Policies are few by definition (at most 64), so a label is compared with them inside its row.
    """
    every = [*policies, SlicePolicy()]
    tags = F.array_compact(F.array(*[F.when(p.matches(), F.lit(i)) for i, p in enumerate(every)]))
    joined = labels.select("case_id", "label", tags.alias("_tags")).join(
        results.select("case_id", F.col("label").alias("_got")), "case_id", "left"
    ).select("label", "_got", F.explode("_tags").alias("_i"))
    pos, got = F.col("label") == positive, F.col("_got")
    counts = joined.groupBy("_i").agg(
        F.count(F.lit(1)).alias("n"), F.count("_got").alias("judged"), F.count_if(got == F.col("label")).alias("correct"),
        F.count_if(pos).alias("positives"), F.count_if((got == positive) & ~pos).alias("fp"),
        F.count_if((got != positive) & pos).alias("fn"),
    )
    spark = labels.sparkSession
    wanted = spark.createDataFrame(
        [
            (i, p.name, p.minimum_samples, float(p.minimum_agreement), float(p.maximum_false_positive_rate),
             float(p.maximum_false_negative_rate), i == len(policies))
            for i, p in enumerate(every)
        ],
        "_i int, selector string, min_n int, min_agree double, max_fpr double, max_fnr double, overall boolean",
    )
    rows = wanted.join(counts, "_i", "left").fillna(0, ["n", "judged", "correct", "positives", "fp", "fn"])
    negatives = F.col("n") - F.col("positives")
    rows = rows.withColumns({
        "complete": (F.col("judged") == F.col("n")) & (F.col("n") > 0),
        "fpr": F.when(negatives > 0, F.col("fp") / negatives).otherwise(0.0),
        "fnr": F.when(F.col("positives") > 0, F.col("fn") / F.col("positives")).otherwise(0.0),
    }).withColumn("agreement", F.when(F.col("complete"), F.col("correct") / F.col("n")))
    within = (
        (F.col("n") >= F.col("min_n")) & (F.col("agreement") >= F.col("min_agree"))
        & (F.col("fpr") <= F.col("max_fpr")) & (F.col("fnr") <= F.col("max_fnr"))
    )
    rows = rows.withColumn("ok", F.col("complete") & (F.col("overall") | F.coalesce(within, F.lit(False))))
    verdict = rows.agg(F.bool_and("ok").alias("all_ok"), F.lit(True).alias("overall"))
    return rows.join(verdict, "overall", "left").select(
        "selector", F.col("n").alias("sample_count"), "agreement", F.col("fp").alias("false_positive_count"),
        F.col("fn").alias("false_negative_count"), F.when(F.col("n") > 0, F.col("fpr")).alias("false_positive_rate"),
        F.when(F.col("n") > 0, F.col("fnr")).alias("false_negative_rate"),
        F.when(F.col("ok"), "ELIGIBLE").otherwise("INELIGIBLE").alias("status"),
        F.when(F.col("overall"), F.when(F.col("all_ok"), "ELIGIBLE").otherwise("INELIGIBLE")).alias("eligibility"),
    )


def calibration_pin_rejects(labels: DataFrame, results: DataFrame, pins: Sequence[str]) -> DataFrame:
    """Results that name no label, repeat one, or differ from it in a pin column."""
    pinned = labels.select("case_id", *[F.col(p).alias(f"_{p}") for p in pins], F.lit(True).alias("_known"))
    joined = results.join(pinned, "case_id", "left")
    differs = F.lit(False)
    for p in pins:
        differs = differs | ~F.col(p).eqNullSafe(F.col(f"_{p}"))
    bad = joined.select(
        "case_id", F.when(F.col("_known").isNull(), "unknown_case").when(differs, "pin_mismatch").alias("rule")
    ).filter("rule IS NOT NULL")
    twice = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "case_id", F.lit("duplicate_result").alias("rule")
    )
    return bad.unionByName(twice).select(
        F.lit("judge_result").alias("entity"), F.col("case_id").alias("id"), "rule",
        F.lit("JUDGE_PIN_INVALID").alias("code"),
    )


def label_pin_rejects(labels: DataFrame, cases: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Calibration labels that differ from their reviewed case in source, evidence or slices."""
    same = ("source_id", "source_digest", "evidence_id", "evidence_digest", "slices")
    known = cases.select("case_id", *[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("_known"))
    marked = reviewed.filter("is_reviewed").select("case_id", F.lit(True).alias("_reviewed"))
    joined = labels.join(known, "case_id", "left").join(marked, "case_id", "left")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rule = (
        F.when(F.col("_known").isNull(), "unknown_case").when(F.col("_reviewed").isNull(), "not_reviewed")
        .when(differs, "pin_mismatch")
    )
    return joined.select(
        F.lit("judge_label").alias("entity"), F.col("case_id").alias("id"), rule.alias("rule"),
        F.lit("JUDGE_PIN_INVALID").alias("code"),
    ).filter("rule IS NOT NULL")


# ---------------------------------------------------------------- gates


@dataclass(frozen=True)
class Gate:
    gate_id: str
    metric_id: str
    owner: str
    selector: Mapping[str, str] = field(default_factory=dict)
    aggregation: str = "mean"
    threshold: float = 0.0
    direction: str = "higher_is_better"
    minimum_samples: int = 1
    failure_code: str | None = None

    def row(self) -> tuple:
        return (
            self.gate_id, self.metric_id, self.owner, dict(self.selector), self.aggregation, float(self.threshold),
            self.direction, self.minimum_samples, self.failure_code,
        )


GATE_SCHEMA = (
    "gate_id string, metric_id string, owner string, selector map<string,string>, aggregation string, "
    "threshold double, direction string, minimum_samples int, failure_code string"
)


def gate_table(spark, gates: Sequence[Gate]) -> DataFrame:
    return spark.createDataFrame([g.row() for g in gates], GATE_SCHEMA)


def gate_selection(reports: DataFrame, gates: DataFrame) -> DataFrame:
    """Reports chosen by each gate: equi-join on metric and owner, then the slice selector."""
    slices = F.map_from_arrays(
        F.array(*[F.lit(s) for s in SLICES]),
        F.array(*[F.coalesce(F.col("slices")[s], F.lit("")) for s in SLICES]),
    )
    fits = F.forall(
        F.map_entries("selector"), lambda e: F.coalesce(F.col("_s")[e["key"]] == e["value"], F.lit(False))
    )
    tagged = reports.withColumn("_s", slices)
    return tagged.join(gates, ["metric_id", "owner"]).filter(fits).drop("_s")


def evaluate_gates(reports: DataFrame, gates: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """State, reason, samples and value of each gate.

    `matches` (report_id, decision_id) feeds `any_failure` gates.
    """
    chosen = gate_selection(reports, gates)
    if matches is None:
        flagged = chosen.withColumn("_codes", F.array().cast("array<string>"))
    else:
        codes = matches.filter(F.col("decision_id").isNotNull()).groupBy("report_id").agg(
            F.collect_set(F.lower("decision_id")).alias("_codes")
        )
        flagged = chosen.join(codes, "report_id", "left")
    failed = F.lit(False)
    for kind, words in FAILURES.items():
        hit = F.arrays_overlap(F.coalesce("_codes", F.array().cast("array<string>")), F.array(*map(F.lit, words)))
        failed = failed | ((F.col("failure_code") == kind) & hit)
    eligible = F.col("eligibility") if "eligibility" in reports.columns else F.lit(None).cast("string")
    value = F.when(F.col("status") == VALUE, F.col("value"))
    sums = flagged.groupBy("gate_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == VALUE).alias("_v"), F.avg(value).alias("_mean"),
        F.bool_or((F.col("owner") == "judge") & ~eligible.eqNullSafe("ELIGIBLE")).alias("_barred"),
        F.bool_or(F.coalesce(failed, F.lit(False))).alias("_failed"),
        F.count_if(F.col("status") == NOT_APPLICABLE).alias("not_applicable_count"),
        F.count_if(F.col("status") == INSUFFICIENT_LABELS).alias("insufficient_labels_count"),
    )
    rows = gates.join(sums, "gate_id", "left")
    passes = F.when(F.col("direction") == "higher_is_better", F.col("_mean") >= F.col("threshold")).otherwise(
        F.col("_mean") <= F.col("threshold")
    )
    any_failure = F.col("aggregation") == "any_failure"
    none, barred = F.col("_n").isNull(), F.col("_barred")
    short = (F.col("_v") < F.col("minimum_samples")) | (F.col("_v") < F.col("_n"))
    state = (
        F.when(none, "INSUFFICIENT").when(barred, "INELIGIBLE").when(short, "INSUFFICIENT")
        .when(any_failure, F.when(F.col("_failed"), "FAIL").otherwise("PASS"))
        .otherwise(F.when(passes, "PASS").otherwise("FAIL"))
    )
    reason = (
        F.when(none, "NO_SELECTED_REPORTS").when(barred, "JUDGE_NOT_ELIGIBLE")
        .when(short, "INSUFFICIENT_OR_MISSING_DATA")
        .when(any_failure, F.when(F.col("_failed"), "ANY_FAILURE").otherwise("NO_FAILURE")).otherwise("THRESHOLD")
    )
    worth = F.when(any_failure, F.when(F.col("_failed"), 0.0).otherwise(1.0)).otherwise(F.col("_mean"))
    return rows.select(
        "gate_id", "metric_id", "owner", state.alias("state"), reason.alias("reason"),
        F.when(none | barred, 0).otherwise(F.col("_v")).cast("long").alias("sample_count"),
        F.when(none | barred | short, F.lit(None)).otherwise(worth).alias("value"),
    )


def gate_state_counts(reports: DataFrame, gates: DataFrame) -> DataFrame:
    chosen = gate_selection(reports, gates)
    return chosen.groupBy("gate_id").agg(
        F.count_if(F.col("status") == VALUE).alias("value_count"),
        F.count_if(F.col("status") == NOT_APPLICABLE).alias("not_applicable_count"),
        F.count_if(F.col("status") == INSUFFICIENT_LABELS).alias("insufficient_labels_count"),
    )


def layer_reports(reports: DataFrame) -> DataFrame:
    """Reports per layer; context counts as retrieval. Long form (layer, report_id)."""
    layer = F.when(F.col("owner") == "context", "retrieval").otherwise(F.col("owner"))
    return reports.select(layer.alias("layer"), "report_id").filter(F.col("layer").isin(*LAYERS))


def dataset_summary(annotations: DataFrame, query_cases: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per dataset, over its latest revision: annotations, query cases, reviewed cases, total."""
    kinds = annotations.select("dataset_id", "revision", "case_id", F.lit(1).alias("a"), F.lit(0).alias("q")).unionByName(
        query_cases.select("dataset_id", "revision", "case_id", F.lit(0).alias("a"), F.lit(1).alias("q"))
    )
    latest = kinds.groupBy("dataset_id").agg(F.max("revision").alias("revision"))
    marked = reviewed.filter("is_reviewed").select("case_id", F.lit(1).alias("r"))
    return (
        kinds.join(latest, ["dataset_id", "revision"]).join(marked, "case_id", "left")
        .groupBy("dataset_id", "revision").agg(
            F.sum("a").alias("annotations"), F.sum("q").alias("query_cases"),
            F.sum(F.coalesce("r", F.lit(0))).alias("reviewed"), F.count(F.lit(1)).alias("total"),
        )
    )


def document_stats(values: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Count, sum and mean of stage counters per document or query."""
    return values.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(m).alias(f"{m}_sum") for m in measures], *[F.avg(m).alias(f"{m}_avg") for m in measures],
    )

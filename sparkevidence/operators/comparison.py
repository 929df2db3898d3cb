"""Baseline-versus-candidate comparison, failure tracing and replay."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import digest
from ..session import materialize
from .quality import VALUE

# The inputs two comparable runs must share; the allowed upstream stages.
FIXED_INPUTS = (
    "dataset_snapshot_id", "dataset_snapshot_digest", "taxonomy_digest", "input_catalog_digest",
    "case_ids", "metric_ids", "gates", "runtime", "confidence_policy",
)
UPSTREAM = {
    "ingestion": ("source",),
    "fusion": ("retrieval",),
    "rerank": ("fusion", "retrieval"),
    "evidence": ("rerank", "fusion", "retrieval"),
    "generation": ("evidence",),
    "verification": ("generation", "evidence"),
    "final_response": ("verification", "generation", "evidence"),
    "metric_report": ("final_response", "evidence"),
}
ROLES = (
    "source", "ingestion", "retrieval", "fusion", "rerank", "evidence", "generation", "verification", "final_response"
)


def axis_diff(plans: DataFrame, experiment: str | None = None) -> DataFrame:
    """Changed plan keys per comparison and the resulting mode.

    Plans: (comparison_id, subject 'baseline'|'candidate', axis, plan map<string,string>).
    """
    flat = plans.select("comparison_id", "subject", "axis", F.explode("plan").alias("key", "value"))
    left = flat.filter("subject = 'baseline'").select("comparison_id", "axis", "key", F.col("value").alias("b"))
    right = flat.filter("subject = 'candidate'").select("comparison_id", "axis", "key", F.col("value").alias("c"))
    changed = left.join(right, ["comparison_id", "axis", "key"], "full").filter(~F.col("b").eqNullSafe(F.col("c")))
    names = F.concat_ws(".", "axis", "key")
    grouped = changed.groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("changes"), F.array_sort(F.collect_list(names)).alias("changed_keys")
    )
    every = plans.select("comparison_id").distinct().join(grouped, "comparison_id", "left")
    n = F.coalesce("changes", F.lit(0))
    many = F.lit("MULTI_AXIS_NON_CAUSAL" if experiment else "REJECTED_NEEDS_EXPERIMENT")
    return every.select(
        "comparison_id", n.alias("changes"),
        F.when(n == 0, "REJECTED_NO_CHANGE").when(n == 1, "SINGLE_AXIS").otherwise(many).alias("mode"),
        F.coalesce("changed_keys", F.array().cast("array<string>")).alias("changed_keys"),
    )


def delta(baseline: Column, candidate: Column) -> dict[str, Column]:
    missing = baseline.isNull() | candidate.isNull()
    return {
        "absolute": candidate - baseline,
        "relative": F.when(~missing & (baseline != 0), (candidate - baseline) / F.abs(baseline)),
        "relative_state": F.when(missing, "NOT_MEANINGFUL").when(baseline == 0, "UNDEFINED_BASELINE_ZERO").otherwise(VALUE),
    }


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pairs of reports by metric, owner, case and slices, each with its delta."""
    keys = ["metric_id", "owner", "_case", "_slices"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "metric_id", "owner", F.coalesce("case_id", F.lit("")).alias("_case"), F.to_json("slices").alias("_slices"),
            F.col("status").alias(f"{tag}_status"), F.col("value").alias(f"{tag}_value"),
        )

    pairs = side(baseline, "baseline").join(side(candidate, "candidate"), keys, "full")
    change = delta(F.col("baseline_value"), F.col("candidate_value"))
    return pairs.select(
        "metric_id", "owner", F.nullif(F.col("_case"), F.lit("")).alias("case_id"), F.col("_slices").alias("slices"),
        "baseline_status", "baseline_value", "candidate_status", "candidate_value",
        *[c.alias(n) for n, c in change.items()],
    )


def recommendation(gate_results: DataFrame, hard_only: bool = False) -> DataFrame:
    """Per comparison: the baseline is retained when any gate result does not pass."""
    counted = gate_results.filter("severity = 'hard'") if hard_only else gate_results
    failed = counted.groupBy("comparison_id").agg(F.bool_or(F.col("state") != "PASS").alias("_bad"))
    every = gate_results.select("comparison_id").distinct().join(failed, "comparison_id", "left")
    return every.select(
        "comparison_id",
        F.when(F.coalesce("_bad", F.lit(False)), "BASELINE_RETAINED").otherwise("CANDIDATE_ELIGIBLE")
        .alias("recommendation"),
    )


def fixed_input_rejects(manifests: DataFrame, pairs: DataFrame, fields: Sequence[str] = FIXED_INPUTS) -> DataFrame:
    """Comparison pairs (baseline_id, candidate_id) whose manifests differ in a fixed input."""
    left = manifests.select(F.col("manifest_id").alias("baseline_id"), *[F.col(f).alias(f"b_{f}") for f in fields])
    right = manifests.select(F.col("manifest_id").alias("candidate_id"), *[F.col(f).alias(f"c_{f}") for f in fields])
    joined = pairs.join(left, "baseline_id").join(right, "candidate_id")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"c_{f}")), F.lit(f)) for f in fields
    ]))
    return joined.select("baseline_id", "candidate_id", F.explode(differing).alias("rule"))


def comparable_reports(reports: DataFrame, baseline: DataFrame, fields: Sequence[str] = FIXED_INPUTS) -> DataFrame:
    """Each report beside its group's baseline: BASELINE, COMPATIBLE or INCOMPATIBLE.

    Reports: (report_id, group_id, fields...); baseline: (group_id, baseline_id).
    """
    pinned = baseline.join(
        reports.select("group_id", F.col("report_id").alias("baseline_id"), F.lit(True).alias("_found"),
                       *[F.col(f).alias(f"_{f}") for f in fields]),
        ["group_id", "baseline_id"], "left",
    )
    joined = reports.join(pinned, "group_id", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    own = F.col("report_id") == F.col("baseline_id")
    lost = F.col("_found").isNull()
    return joined.select(
        "group_id", "report_id",
        F.when(lost, "INCOMPATIBLE").when(own, "BASELINE").when(same, "COMPATIBLE").otherwise("INCOMPATIBLE").alias("state"),
        F.when(lost, "BASELINE_UNAVAILABLE").when(own | same, F.lit(None)).otherwise("PINNED_INPUTS_NOT_EQUIVALENT")
        .alias("reason"),
    )


def wilson(reports: DataFrame, by: Sequence[str], level: float = 0.95, policy: str = "wilson") -> DataFrame:
    """Wilson interval where a group has exactly one labelled decision or citation value; none under the policy `none`."""
    if policy not in ("wilson", "none"):
        raise ValueError(f"unknown confidence policy {policy}")
    if policy == "none":
        none = F.lit(None).cast("double")
        return reports.select(*by).distinct().select(
            *by, F.lit("NOT_MEANINGFUL").alias("state"), F.lit("POLICY_NONE").alias("reason"), none.alias("lower"), none.alias("upper"))
    z = NormalDist().inv_cdf((1 + level) / 2)
    binary = (
        F.col("owner").isin("decision", "citation") & (F.col("status") == VALUE) & (F.col("labelled_count") > 0)
    )
    sums = reports.groupBy(*by).agg(
        F.count_if(binary).alias("_k"), F.sum(F.when(binary, F.col("labelled_count"))).cast("double").alias("n"),
        F.sum(F.when(binary, F.col("matched_count"))).cast("double").alias("s"),
    )
    one = F.col("_k") == 1
    n, p = F.col("n"), F.col("s") / F.col("n")
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    radius = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return sums.select(
        *by, F.when(one, VALUE).otherwise("NOT_MEANINGFUL").alias("state"),
        F.when(~one, "UNSUPPORTED_AGGREGATE").alias("reason"),
        F.when(one, F.greatest(F.lit(0.0), centre - radius)).alias("lower"),
        F.when(one, F.least(F.lit(1.0), centre + radius)).alias("upper"),
    )


def attribute_subjects(reports: DataFrame, bindings: DataFrame) -> DataFrame:
    """The only subject whose bindings hold all of a report's artifact roles, else a reject reason.

    Reports: (report_id, case_id, roles map<role, artifact_id>); bindings: (subject, case_id, role,
    artifact_id).
    """
    needed = reports.select(
        "report_id", "case_id", F.size("roles").alias("_needed"), F.explode("roles").alias("role", "artifact_id")
    )
    held = needed.join(bindings.distinct(), ["case_id", "role", "artifact_id"]).groupBy(
        "report_id", "_needed", "subject"
    ).agg(F.count(F.lit(1)).alias("_held")).filter("_held = _needed")
    owners = held.groupBy("report_id").agg(F.count(F.lit(1)).alias("_n"), F.min("subject").alias("subject"))
    return reports.select("report_id").join(owners, "report_id", "left").select(
        "report_id", F.when(F.col("_n") == 1, F.col("subject")).alias("subject"),
        F.when(F.col("_n").isNull(), "NOT_PINNED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("ATTRIBUTED").alias("state"),
    )


def failed_cases(gate_results: DataFrame, selection: DataFrame, reports: DataFrame, bindings: DataFrame) -> DataFrame:
    """Reports behind failed gates with one artifact id per stage.

    Selection: (gate_id, report_id); reports: (report_id, case_id, subject). Rows are keyed by
    (case_id, gate_id, report_id).
    """
    failing = gate_results.filter("state = 'FAIL'").select("gate_id")
    links = selection.select("gate_id", "report_id").join(failing, "gate_id", "left_semi").join(
        reports.filter(F.col("case_id").isNotNull()).select("report_id", "case_id", "subject"), "report_id"
    )
    wide = bindings.groupBy("subject", "case_id").pivot("role", list(ROLES)).agg(F.max("artifact_id"))
    return links.join(wide, ["subject", "case_id"], "left")


def lineage_rejects(failed: DataFrame, lineage: DataFrame) -> DataFrame:
    """Present stages without a recorded parent among the present allowed upstream stages.

    Lineage: (child_id, parent_id).
    """
    have = [r for r in ROLES if r in failed.columns] + (["metric_report"] if "metric_report" in failed.columns else [])
    rules = []
    for role, parents in UPSTREAM.items():
        if role not in have:
            continue
        known = F.array_compact(F.array(*[F.col(p) for p in parents if p in have]))
        rules.append(F.struct(F.lit(role).alias("role"), F.col(role).alias("child_id"), known.alias("parents")))
    checks = failed.select("case_id", F.explode(F.array(*rules)).alias("c")).select("case_id", "c.*").filter(
        F.col("child_id").isNotNull() & (F.size("parents") > 0)
    )
    pairs = checks.select("case_id", "role", "child_id", F.explode("parents").alias("parent_id"))
    proven = pairs.join(lineage.select("child_id", "parent_id").distinct(), ["child_id", "parent_id"]).select(
        "case_id", "role", "child_id"
    ).distinct()
    return checks.select("case_id", "role", "child_id").join(
        proven, ["case_id", "role", "child_id"], "left_anti"
    ).select(
        F.lit("failed_case").alias("entity"), F.col("case_id").alias("id"), F.col("role").alias("rule"),
        F.lit("LINEAGE_MISMATCH").alias("code"),
    )


def run_digest(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest of a run's rows: row hashes are summed, so no run is collected anywhere."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(p).alias(f"_h{i}") for i, p in enumerate(parts)]
    )
    return sums.select(*by, digest(F.col("_n"), *[F.col(f"_h{i}") for i in range(4)]).alias("digest"))


def replay_diff(
    original: DataFrame, replayed: DataFrame, by: Sequence[str], columns: Sequence[str],
    expected_runtime: str | None = None, observed_runtime: str | None = None,
) -> DataFrame:
    """STABLE, MODEL_OUTPUT_CHANGED, or ENVIRONMENT_CHANGED, which is decided first."""
    a = run_digest(original, by, columns).withColumnRenamed("digest", "original_digest")
    b = run_digest(replayed, by, columns).withColumnRenamed("digest", "replay_digest")
    moved = bool(expected_runtime and observed_runtime and expected_runtime != observed_runtime)
    same = F.col("original_digest").eqNullSafe(F.col("replay_digest"))
    return a.join(b, list(by), "full").select(
        *by, "original_digest", "replay_digest",
        F.when(F.lit(moved), "ENVIRONMENT_CHANGED").when(same, "STABLE").otherwise("MODEL_OUTPUT_CHANGED").alias("state"),
    )


def validate_manifest(
    manifest: DataFrame, reviewed: DataFrame, registered: Sequence[str], declared: DataFrame, inventory: DataFrame,
    snapshot_digest: str,
) -> DataFrame:
    """Everything that keeps a manifest from running, one reject per finding.

    Manifest: (case_id, metric_id, dataset_snapshot_digest) rows; reviewed: (case_id); declared and
    inventory bindings: (case_id, role, artifact_id, content_digest).
    """
    def found(df: DataFrame, ident: Column, rule: str) -> DataFrame:
        return df.select(
            F.lit("manifest").alias("entity"), ident.cast("string").alias("id"), F.lit(rule).alias("rule"),
            F.lit("MANIFEST_INVALID").alias("code"),
        )

    cases = manifest.select("case_id").distinct().join(reviewed.select("case_id"), "case_id", "left_anti")
    metrics = manifest.select("metric_id").distinct().filter(~F.col("metric_id").isin(*registered))
    stale = manifest.filter(F.col("dataset_snapshot_digest") != snapshot_digest).select("dataset_snapshot_digest").distinct()
    keys = ["case_id", "role", "artifact_id", "content_digest"]
    missing = declared.join(inventory.select(*keys).distinct(), keys, "left_anti")
    return (
        found(cases, F.col("case_id"), "unreviewed_case")
        .unionByName(found(metrics, F.col("metric_id"), "unregistered_metric"))
        .unionByName(found(stale, F.col("dataset_snapshot_digest"), "snapshot_digest"))
        .unionByName(found(missing, F.concat_ws("/", *keys[:3]), "missing_binding"))
    )


def numbered_by_range(ids: DataFrame, id_col: str) -> DataFrame:
    """(child, position, total): ids numbered from 0 in their order over the whole table.

    Ids are dealt into ranges of about equal size, whatever they begin with; each range is numbered by itself,
    behind the counts of the ranges before it. Only one count for each range is ordered in one task.
    """
    ranged = materialize(ids.select(F.col(id_col).alias("child")).repartitionByRange("child").withColumn("_range", F.spark_partition_id()), "catalog")
    every = Window.partitionBy(F.lit(0)).orderBy("_range")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_range", (F.sum("_n").over(every) - F.col("_n")).alias("_before"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("child"))
    return ranged.withColumn("_at", inside).join(offsets, "_range").select("child", (F.col("_before") + F.col("_at") - 1).alias("position"), "total")


def catalog_level(ids: DataFrame, id_col: str, fanout: int = 64) -> DataFrame:
    """First level of the catalog: (parent, position, child) groups of `fanout` ordered ids."""
    numbered = numbered_by_range(ids, id_col)
    return numbered.select((F.floor(F.col("position") / fanout)).cast("long").alias("parent"), "position", "child", "total")


def catalog_levels(ids: DataFrame, id_col: str, fanout: int = 64) -> DataFrame:
    """All levels up to one root: (level, parent, children).

    A group of the first level stands for those of every upper level that begin with it; how many children they
    have follows from the total, so upper levels need neither a shuffle nor an action.
    """
    if fanout < 2:
        raise ValueError("fanout is 2 or more")
    first = catalog_level(ids, id_col, fanout).groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max("total").alias("total"))
    # Powers of the fan-out within a long: the span of a group of each level, in groups of the first one.
    spans = [fanout**k for k in range(1, 63) if fanout**k < 1 << 62]
    power = F.array(*[F.lit(x).cast("long") for x in [1, *spans]])
    groups = F.expr(f"(total + {fanout - 1}) div {fanout}")
    # x / span rounded up: what is left of the division goes first, so it is exact.
    up = lambda x, span: ((x + span - 1 - (x + span - 1) % span).cast("decimal(38,0)") / span).cast("long")
    below = lambda level: up(groups, F.element_at(power, level))  # noqa: E731 - groups of the level beneath
    levels = F.filter(F.sequence(F.lit(1), F.lit(len(spans))), lambda n: (F.col("parent") % F.element_at(power, n + 1) == 0) & (below(n) > 1))
    upper = first.select("parent", "total", F.explode(levels).alias("level"))
    parent = F.col("parent").cast("decimal(38,0)") / F.element_at(power, F.col("level") + 1)
    upper = upper.select("level", parent.cast("long").alias("parent"), F.least(F.lit(fanout), below(F.col("level")) - parent.cast("long") * fanout).alias("children"))
    return first.select(F.lit(0).alias("level"), "parent", "children").unionByName(upper)

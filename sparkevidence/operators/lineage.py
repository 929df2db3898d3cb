"""Run, attempt, artifact and lineage analytics.

Tables: runs(run_id, engine_kind, state, terminal_state, created_at, started_at, ended_at, plan_id),
attempts(attempt_id, run_id, stage_key, attempt_number, state, ended_at, safe_error),
artifacts(artifact_id, artifact_type, schema_revision, producing_run_id, producing_attempt_id,
created_at, ...), lineage(artifact_id, parent_id).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .scans import blocked_row_number, blocked_scan

# Run states and stage positions.
OPEN_STATES = ("PENDING", "RUNNING")
TERMINAL_STATES = ("SUCCEEDED", "FAILED")
FIRST_STAGE = "query.input"


def _newest(value: Column, time: str, ident: str) -> Column:
    """The value of the newest row of a group; combines map-side, unlike a sorted window."""
    return F.max_by(value, F.struct(F.col(time), F.col(ident)))


# ---------------------------------------------------------------- closures


def closure(seeds: DataFrame, edges: DataFrame, written: bool = False) -> DataFrame:
    """All (root, node, depth) reachable from the seeds (root, node); depth is the shortest.

    Edges: (source, target); written: they are read from a table, so they are not written again. Level by level: each round joins the newest level with the edges and
    drops pairs already seen, so shared ancestors are expanded once. Every level is written to the
    shared folder, which keeps the plan short and survives executor loss. Runs jobs until a level
    is empty.
    """
    # An edge that stands twice is no harm: what a level reaches is made distinct.
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("_next"))
    if not written:
        step = materialize(step, "closure-edges")
    level = materialize(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)), "closure")
    seen = level
    depth = 0
    while True:  # a cycle ends as well: its pairs have been seen
        depth += 1
        reached = level.join(step, "node").select("root", F.col("_next").alias("node")).distinct()
        fresh = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level = materialize(fresh.withColumn("depth", F.lit(depth)), "closure")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def _succeeded(artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    done = attempts.filter("state = 'SUCCEEDED'").select(F.col("attempt_id").alias("producing_attempt_id"))
    return artifacts.join(done, "producing_attempt_id", "left_semi")


def descendants(
    sources: DataFrame, artifacts: DataFrame, attempts: DataFrame, lineage: DataFrame
) -> DataFrame:
    """Succeeded descendants of each source (itself included) within the source's run.

    Sources: (source_id, run_id). Returns (source_id, run_id, artifact_id, depth).
    """
    good = _succeeded(artifacts, attempts).select("artifact_id", F.col("producing_run_id").alias("run_id"))
    seeds = sources.join(
        good.withColumnRenamed("artifact_id", "source_id"), ["source_id", "run_id"], "left_semi"
    )
    child = good.select(F.col("artifact_id").alias("_c"), F.col("run_id").alias("_r"))
    parent = good.select(F.col("artifact_id").alias("_p"), F.col("run_id").alias("_r"))
    edges = (
        lineage.select(F.col("artifact_id").alias("_c"), F.col("parent_id").alias("_p"))
        .join(child, "_c").join(parent, ["_p", "_r"])
        .select(F.col("_p").alias("source"), F.col("_c").alias("target"))
    )
    reached = closure(
        seeds.select(F.col("source_id").alias("root"), F.col("source_id").alias("node")), edges
    )
    runs = seeds.select("source_id", "run_id").distinct()
    return reached.select(
        F.col("root").alias("source_id"), F.col("node").alias("artifact_id"), "depth"
    ).join(runs, "source_id")


def eligible_artifacts(artifacts: DataFrame, attempts: DataFrame, lineage: DataFrame) -> DataFrame:
    """Every artifact with `eligible`: it and all its ancestors come from succeeded attempts.

    Failure is pushed down the graph instead of listing each artifact's ancestors.
    """
    good = _succeeded(artifacts, attempts).select("artifact_id")
    failed = artifacts.select("artifact_id").join(good, "artifact_id", "left_anti")
    edges = lineage.select(F.col("parent_id").alias("source"), F.col("artifact_id").alias("target"))
    tainted = closure(
        failed.select(F.lit(0).alias("root"), F.col("artifact_id").alias("node")), edges, written=True
    ).select(F.col("node").alias("artifact_id"), F.lit(False).alias("_ok"))
    return artifacts.select("artifact_id").join(tainted, "artifact_id", "left").select(
        "artifact_id", F.coalesce("_ok", F.lit(True)).alias("eligible")
    )


def source_of_evidence(
    wanted: DataFrame, lineage: DataFrame, contents: DataFrame
) -> DataFrame:
    """The nearest ancestor that contains one of the wanted locators; of several equally near, the smallest id.

    Wanted: (index_id, locator_key); contents: (artifact_id, locator_key) of elements and chunks. All indexes
    climb together, level by level, and an index leaves the frontier at its first hit, so ancestors behind
    that one are never listed; an index whose locators nothing holds does not climb at all. Runs jobs until the frontier is empty; a cycle ends as its pairs have been seen.
    """
    asked = materialize(wanted.select("index_id", "locator_key").distinct(), "asked")
    needed = materialize(
        contents.select("artifact_id", "locator_key").distinct().join(asked.select("locator_key").distinct(), "locator_key", "left_semi"),
        "needed",
    )
    held = materialize(asked.join(needed.select("locator_key").distinct(), "locator_key", "left_semi"), "held")
    step = lineage.select("artifact_id", F.col("parent_id").alias("_next"))
    level = materialize(held.select("index_id", F.col("index_id").alias("artifact_id")).distinct(), "frontier")
    seen, found, depth = level, [], 0
    while True:
        hits = level.join(needed, "artifact_id").join(held, ["index_id", "locator_key"], "left_semi")
        nearest = hits.groupBy("index_id").agg(F.min("artifact_id").alias("artifact_id")).withColumn("depth", F.lit(depth))
        found.append(materialize(nearest, "nearest"))
        reached = (
            level.join(found[-1].select("index_id"), "index_id", "left_anti").join(step, "artifact_id")
            .select("index_id", F.col("_next").alias("artifact_id")).distinct()
        )
        level = materialize(reached.join(seen, ["index_id", "artifact_id"], "left_anti"), "frontier")
        if level.isEmpty():
            break
        seen, depth = seen.unionByName(level), depth + 1
    return asked.select("index_id").distinct().join(reduce(DataFrame.unionByName, found), "index_id", "left")


# ---------------------------------------------------------------- listings


def latest_output(artifacts: DataFrame, attempts: DataFrame, source_stage: str = "ingestion.source") -> DataFrame:
    """Newest artifact of each run from a succeeded attempt other than the source's."""
    done = attempts.filter((F.col("state") == "SUCCEEDED") & (F.col("stage_key") != source_stage)).select(
        F.col("attempt_id").alias("producing_attempt_id"), F.col("run_id").alias("producing_run_id")
    )
    return (
        artifacts.join(done, ["producing_attempt_id", "producing_run_id"], "left_semi")
        .groupBy(F.col("producing_run_id").alias("run_id"))
        .agg(_newest(F.col("artifact_id"), "created_at", "artifact_id").alias("output_artifact_id"))
    )


def list_documents(
    submissions: DataFrame, artifacts: DataFrame, runs: DataFrame, attempts: DataFrame, evidence: DataFrame,
    limit: int = 50, cursor: tuple | None = None, source_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Registered documents, newest first, one keyset page with `has_more`.

    Submissions: (source_id, run_id, filename, media_type, registered_at); evidence: (run_id,
    resolution_json). The page is cut before anything large is joined to it.
    """
    source = artifacts.select(
        F.col("artifact_id").alias("source_id"), "byte_size", F.col("producing_attempt_id").alias("attempt_id")
    )
    first = attempts.filter("stage_key = 'ingestion.source' AND state = 'SUCCEEDED'").select("attempt_id", "run_id")
    # What few runs decide goes first, so that only the rest of the submissions meets the artifacts.
    ingested = submissions.join(runs.filter("engine_kind = 'ingestion'").select("run_id", F.col("state").alias("run_state")), "run_id").join(
        evidence.select("run_id", "resolution_json"), "run_id")
    rows = ingested.join(source, "source_id").join(first, ["attempt_id", "run_id"], "left_semi")
    if source_ids is not None:
        rows = rows.filter(F.col("source_id").isin(*source_ids))
    if cursor is not None:
        seen_at, seen_id = cursor
        rows = rows.filter(
            (F.col("registered_at") < F.lit(seen_at))
            | ((F.col("registered_at") == F.lit(seen_at)) & (F.col("source_id") < F.lit(seen_id)))
        )
    # Written, because its rows and the runs on it would otherwise join all artifacts again.
    page = materialize(rows.orderBy(F.desc("registered_at"), F.desc("source_id")).limit(limit + 1), "document-page")
    place = F.row_number().over(Window.orderBy(F.desc("registered_at"), F.desc("source_id")))
    placed = page.withColumn("position", place).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    field = lambda path: F.nullif(F.get_json_object("resolution_json", path), F.lit(""))
    shown = placed.filter(F.col("position") <= limit)
    # Only the runs on the page are looked up among the artifacts and attempts.
    asked = shown.select("run_id").distinct()
    outputs = latest_output(
        artifacts.join(asked.withColumnRenamed("run_id", "producing_run_id"), "producing_run_id", "left_semi"),
        attempts.join(asked, "run_id", "left_semi"),
    )
    return shown.join(outputs, "run_id", "left").select(
        "position", "source_id", "run_id", "filename", "media_type", "registered_at", "byte_size", "run_state",
        field("$.observables.extension").alias("format"), field("$.observables.document_class").alias("document_class"),
        field("$.selected_profile_id").alias("profile_id"), "output_artifact_id",
        (F.col("_n") > limit).alias("has_more"),
    )


def recent_runs(runs: DataFrame, attempts: DataFrame, limit: int = 8) -> DataFrame:
    """Newest runs with the latest safe error of each."""
    page = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    errors = (
        attempts.filter("state = 'FAILED' AND safe_error IS NOT NULL").join(page.select("run_id"), "run_id", "left_semi")
        .groupBy("run_id").agg(_newest(F.col("safe_error"), "ended_at", "attempt_id").alias("safe_error"))
    )
    return page.join(errors, "run_id", "left")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("state").isin(*OPEN_STATES)).alias("active"))


def number_attempts(attempts: DataFrame, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Attempt numbers from 1 per (run, stage) in arrival order; `bucket` grows with the order."""
    return blocked_row_number(attempts, ["run_id", "stage_key"], bucket, order, "attempt_number", 1)


def attempt_input_rejects(inputs: DataFrame, artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Inputs (attempt_id, artifact_id) that do not come from a succeeded attempt."""
    good = _succeeded(artifacts, attempts).select("artifact_id")
    return inputs.join(good, "artifact_id", "left_anti").select(
        F.lit("stage_attempt").alias("entity"), F.col("attempt_id").cast("string").alias("id"),
        F.lit("input_succeeded").alias("rule"), F.lit("LINEAGE_INELIGIBLE").alias("code"),
    )


def run_trace(
    runs: DataFrame, plans: DataFrame, attempts: DataFrame, inputs: DataFrame, outputs: DataFrame,
    run_ids: Sequence[str] | None = None, metrics: DataFrame | None = None, signals: DataFrame | None = None,
) -> DataFrame:
    """One row per attempt with its run, plan digest and ordered inputs, outputs, metrics, signals.

    An attempt has at most 64 inputs and outputs, so the lists are bounded.
    """
    kept = runs if run_ids is None else runs.filter(F.col("run_id").isin(*run_ids))
    rows = attempts.join(kept.select("run_id", "engine_kind", F.col("state").alias("run_state"), "plan_id"), "run_id").join(
        plans.select("plan_id", "plan_digest"), "plan_id", "left"
    )

    def listed(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return df.groupBy("attempt_id").agg(F.transform(pairs, lambda x: x["v"]).alias(name))

    rows = rows.join(listed(inputs, "ordinal", F.col("artifact_id"), "inputs"), "attempt_id", "left")
    rows = rows.join(listed(outputs, "ordinal", F.col("artifact_id"), "outputs"), "attempt_id", "left")
    if metrics is not None:
        rows = rows.join(listed(metrics, "name", F.struct("name", "value"), "metrics"), "attempt_id", "left")
    if signals is not None:
        rows = rows.join(listed(signals, "name", F.struct("name", "status", "value"), "signals"), "attempt_id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumn("inputs", F.coalesce("inputs", empty)).withColumn("outputs", F.coalesce("outputs", empty))


def run_kind(engine: Column, plan_kind: Column) -> Column:
    return (
        F.when(plan_kind == "evaluation_comparison", "COMPARISON").when(plan_kind == "contract_test", "CONTRACT_TEST")
        .when(engine.isin("ingestion", "query", "evaluation"), F.upper(engine)).otherwise("UNKNOWN")
    )


def duration_ms(started: Column, ended: Column) -> Column:
    micros = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), F.floor(micros / 1000))).cast("long")


def run_history(
    runs: DataFrame, run_type: str = "", state: str = "", search: str = "", limit: int | None = None
) -> DataFrame:
    """Runs with type and duration, filtered; needs (plan_kind, plan_digest, profile_id)."""
    rows = runs
    if limit is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    rows = rows.select(
        "run_id", run_kind(F.col("engine_kind"), F.col("plan_kind")).alias("type"), "state", "created_at",
        duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"), "plan_digest", "profile_id",
    )
    needle = search.strip().lower()
    if run_type:
        rows = rows.filter(F.col("type") == run_type.upper())
    if state:
        rows = rows.filter(F.col("state") == state.upper())
    if needle:
        hay = F.lower(F.concat_ws("\n", F.col("run_id").cast("string"), "plan_digest", "profile_id"))
        rows = rows.filter(F.contains(hay, F.lit(needle)))
    return rows


def latest_per_plugin(runs: DataFrame, attempts: DataFrame, engine: str = "evaluation") -> DataFrame:
    """Newest run of one engine per plugin."""
    kept = runs.filter(F.col("engine_kind") == engine).select("run_id", "state", "created_at")
    return attempts.select("run_id", "plugin_id").distinct().join(kept, "run_id").groupBy("plugin_id").agg(
        F.max(F.struct("created_at", "run_id", "state")).alias("_r")
    ).select("plugin_id", F.col("_r.run_id").alias("run_id"), F.col("_r.state").alias("state"),
             F.col("_r.created_at").alias("created_at"))


def latest_revisions(revisions: DataFrame, search: str = "", limit: int | None = None) -> DataFrame:
    """Newest revision of each dataset whose text contains `search`, newest first."""
    latest = revisions.groupBy("dataset_id").agg(
        F.max_by(F.struct(*[c for c in revisions.columns if c != "dataset_id"]), F.col("revision")).alias("_r")
    ).select("dataset_id", "_r.*")
    if search:
        latest = latest.filter(F.contains(F.lower("content"), F.lit(search.lower())))
    if limit is not None:
        latest = latest.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(limit)
    return latest


def stage_order(attempts: DataFrame, plan_stages: DataFrame) -> DataFrame:
    """Plan position of each attempt: that of the longest stage id its key starts with, null if none does.

    Plan stages: (plan_id, stage_id, position). Each key is expanded to its dotted prefixes, which
    turns the prefix match into an equi-join.
    """
    pieces = F.split("stage_key", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), ".")
    )
    keys = attempts.select("plan_id", "stage_key").distinct().withColumn("stage_id", F.explode(prefixes))
    found = keys.join(plan_stages, ["plan_id", "stage_id"]).groupBy("plan_id", "stage_key").agg(
        F.max_by("position", F.length("stage_id")).alias("_pos")
    )
    position = F.when(F.col("stage_key") == FIRST_STAGE, -1).otherwise(F.col("_pos"))
    return attempts.join(found, ["plan_id", "stage_key"], "left").withColumn("position", position).drop("_pos")


def artifact_catalog(
    artifacts: DataFrame, artifact_type: str, revision: str = "v1", limit: int = 100
) -> DataFrame:
    chosen = artifacts.filter((F.col("artifact_type") == artifact_type) & (F.col("schema_revision") == revision))
    return chosen.orderBy(F.desc("artifact_id")).limit(limit)


def run_artifacts(artifacts: DataFrame, lineage: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    """Outputs of runs with their (at most 64) parents in order."""
    kept = artifacts if run_ids is None else artifacts.join(
        run_ids.select(F.col("run_id").alias("producing_run_id")), "producing_run_id", "left_semi"
    )
    parents = lineage.groupBy("artifact_id").agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
    return kept.join(parents, "artifact_id", "left").withColumn(
        "parents", F.coalesce("parents", F.array().cast("array<string>"))
    )


def newest_comparisons(artifacts: DataFrame, runs: DataFrame, attempts: DataFrame, limit: int = 4) -> DataFrame:
    done = runs.filter("state = 'SUCCEEDED'").select(F.col("run_id").alias("producing_run_id"))
    found = _succeeded(artifacts.filter("artifact_type = 'evaluation.comparison'"), attempts)
    return found.join(done, "producing_run_id", "left_semi").orderBy(
        F.desc("created_at"), F.desc("artifact_id")
    ).limit(limit)


def transition_rejects(transitions: DataFrame) -> DataFrame:
    """Illegal state changes. Transitions: (run_id, seq, state), seq counting from 0 per run.

    A run opens as PENDING, may become RUNNING, and ends in exactly one terminal state.
    """
    seen = blocked_scan(
        transitions, ["run_id"], "seq", {"_prev": F.col("state")}, include_current=False
    )
    prev, state = F.col("_prev"), F.col("state")
    legal = (
        (prev.isNull() & state.isin(*OPEN_STATES))
        | ((prev == "PENDING") & state.isin("RUNNING", *TERMINAL_STATES))
        | ((prev == "RUNNING") & state.isin(*TERMINAL_STATES))
    )
    return seen.filter(~F.coalesce(legal, F.lit(False))).select(
        F.lit("run").alias("entity"), F.col("run_id").cast("string").alias("id"), "seq",
        F.lit("state_transition").alias("rule"), F.lit("RUN_STATE_INVALID").alias("code"),
    )


def late_attempt_rejects(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts started after their run ended."""
    ended = runs.filter(F.col("ended_at").isNotNull()).select("run_id", F.col("ended_at").alias("_end"))
    return attempts.join(ended, "run_id").filter(F.col("started_at") > F.col("_end")).select(
        F.lit("stage_attempt").alias("entity"), F.col("attempt_id").cast("string").alias("id"),
        F.lit("run_open").alias("rule"), F.lit("RUN_STATE_INVALID").alias("code"),
    )


# ---------------------------------------------------------------- document views

# What a view shows of a text unless asked otherwise, and the cells on one page.
ELEMENT_CHARS = 2048
CHUNK_CHARS = 4096
PAGE_CELLS = 512


def _part(text: Column, chars: int | None, start: int) -> tuple[Column, Column]:
    """`chars` characters of a text from `start` (all of it for None), and whether more follow."""
    rest = F.substring(text, start + 1, 2**31 - 1 - start) if start else text
    if chars is None:
        return rest, F.lit(False)
    return F.substring(rest, 1, chars), F.length(rest) > chars


def element_view(
    elements: DataFrame, limit: int = 50, offset: int = 0, chars: int | None = ELEMENT_CHARS, start: int = 0
) -> DataFrame:
    """One page of each document's elements; positions are the reading order."""
    rows = elements.filter(F.col("reading_order").between(offset, offset + limit - 1))
    text, more = _part(F.coalesce("text", F.lit("")), chars, start)
    return rows.select("document_id", "reading_order", "id", "kind", text.alias("text"), more.alias("truncated"))


def chunk_view(
    chunks: DataFrame, limit: int = 25, offset: int = 0, chars: int | None = CHUNK_CHARS, start: int = 0
) -> DataFrame:
    rows = chunks.filter(F.col("ordinal").between(offset, offset + limit - 1))
    content, more = _part(F.col("content"), chars, start)
    return rows.select("document_id", "ordinal", "chunk_id", content.alias("content"), more.alias("truncated"))


def table_view(
    tables: DataFrame, limit: int = 10, offset: int = 0, cell_offset: int = 0, budget: int = PAGE_CELLS
) -> DataFrame:
    """One page of each document's tables under a budget of cells, which can split a table.

    Tables: (document_id, table_id, table_no, cells). At most `limit` rows per document are looked at.
    """
    rows = tables.filter(F.col("table_no").between(offset, offset + limit - 1))
    first = F.when(F.col("table_no") == offset, cell_offset).otherwise(0)
    before = Window.partitionBy("document_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.withColumn("_skip", first).withColumn("_left", F.col("cells") - F.col("_skip")).withColumn(
        "_used", F.coalesce(F.sum("_left").over(before), F.lit(0))
    )
    take = F.least(F.col("_left"), budget - F.col("_used"))
    return left.filter(F.col("_used") < budget).select(
        "document_id", "table_id", "table_no", F.col("_skip").alias("cell_offset"), take.alias("cells_shown"),
        F.col("cells").alias("total_cells"), (F.col("_skip") + take < F.col("cells")).alias("has_more_cells"),
    )


def document_inspector(descended: DataFrame, artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: its last canonical and chunk artifacts and why a view is missing."""
    facts = artifacts.select("artifact_id", "artifact_type", "created_at")
    newest = lambda kind: F.max_by(
        "artifact_id", F.when(F.col("artifact_type") == kind, F.struct("created_at", "artifact_id"))
    )
    kinds = {"canonical": "canonical.document", "chunks": "chunk.set"}
    found = descended.join(facts, "artifact_id").groupBy("source_id", "run_id").agg(*[
        F.when(F.count_if(F.col("artifact_type") == kind) > 0, newest(kind)).alias(f"{name}_id")
        for name, kind in kinds.items()
    ])
    rows = found.join(runs.select("run_id", "state"), "run_id")
    running = F.col("state").isin(*OPEN_STATES)

    def reason(name: str, fallback: str) -> Column:
        return F.when(F.col(f"{name}_id").isNull(), F.when(running, "RUN_IN_PROGRESS").otherwise(fallback))

    return rows.select(
        "source_id", "run_id", "canonical_id", reason("canonical", "CANONICAL_UNAVAILABLE").alias("canonical_reason"),
        "chunks_id", reason("chunks", "CHUNKSET_UNAVAILABLE").alias("chunks_reason"),
    )

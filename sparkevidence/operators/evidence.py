"""Budgeted evidence from ranked candidates, with a decision for every candidate considered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import locator_key, stable_id
from ..functions.text import token_count


@dataclass(frozen=True)
class ContextConfig:
    max_items: int = 8
    max_tokens: int = 2048
    max_excerpt_chars: int = 1024
    minimum_items: int = 1
    structural_rule: str = "none"
    expand_parent: bool = False
    neighbor_window: int = 0
    source_diversity: str = "none"

    def __post_init__(self) -> None:
        if self.minimum_items > self.max_items:
            raise ValueError("minimum items cannot exceed maximum items")
        if self.structural_rule == "none" and (self.expand_parent or self.neighbor_window):
            raise ValueError("expansion needs a structural rule")
        if not 0 <= self.neighbor_window <= 2:
            raise ValueError("neighbor window is 0, 1 or 2")


def citation_key(document_id: Column, chunk_id: Column, element_ids: Column, locators: Column) -> Column:
    places = F.array_join(F.transform(locators, lambda x: locator_key(x)), ",")
    return stable_id("cit", document_id, chunk_id, F.array_join(element_ids, ","), places)


def evidence_id(key: Column) -> Column:
    return stable_id("evd", key)


def citation_ids(items: DataFrame) -> DataFrame:
    """Add `citation_key` and `evidence_id` to rows with document, chunk, elements and locators."""
    key = citation_key(F.col("document_id"), F.col("chunk_id"), F.col("element_ids"), F.col("locators"))
    return items.withColumn("citation_key", key).withColumn("evidence_id", evidence_id(F.col("citation_key")))


def normalize_candidates(candidates: DataFrame) -> DataFrame:
    """Retrieval, fused and reranked rows in one shape; a fused row speaks through its first source."""
    fused = "contributions" in candidates.columns
    first = F.col("contributions")[0]
    if fused:
        score, ids, places = first["safe_score"], first["element_ids"], first["locators"]
        shown = first["projection"]
        sources = F.transform(
            "contributions",
            lambda c: F.struct(c["contributor_id"].alias("contributor_id"), c["safe_score"].alias("safe_score")),
        )
    else:
        score, ids, places = F.col("safe_score"), F.col("element_ids"), F.col("locators")
        shown = F.col("projection")
        sources = F.array(F.struct("contributor_id", "safe_score"))
    return candidates.select(
        "query_id", "index_id", "document_id", "chunk_id", "rank", score.alias("safe_score"),
        ids.alias("element_ids"), places.alias("locators"), sources.alias("contributors"),
        shown["table_element_ids"].alias("table_element_ids"),
    )


def _expansions(base: DataFrame, docs: DataFrame, config: ContextConfig) -> DataFrame:
    """Parent and neighbour chunks of every candidate, in their order of consideration."""
    wanted = []
    if config.expand_parent:
        parents = docs.select(
            "index_id", F.col("chunk_id").alias("parent_chunk_id"),
            F.struct("chunk_id", "document_id", "keyword_text", "citations").alias("x"),
        )
        wanted.append(
            base.join(parents, ["index_id", "parent_chunk_id"]).select(
                "query_id", "index_id", "rank", F.lit(1).alias("_step"), F.lit("expanded_parent").alias("_reason"),
                "safe_score", "contributors", "table_element_ids", "x",
            )
        )
    offsets = [o for n in range(1, config.neighbor_window + 1) for o in (-n, n)]
    if offsets:
        steps = F.array(*[
            F.struct(F.lit(o).alias("o"), F.lit(i + 2).alias("s")) for i, o in enumerate(offsets)
        ])
        placed = docs.select(
            "index_id", "document_id", F.col("ordinal").alias("_at"),
            F.struct("chunk_id", "document_id", "keyword_text", "citations").alias("x"),
        )
        wanted.append(
            base.withColumn("_s", F.explode(steps))
            .withColumn("_at", F.col("ordinal") + F.col("_s.o"))
            .join(placed, ["index_id", "document_id", "_at"])
            .select(
                "query_id", "index_id", "rank", F.col("_s.s").alias("_step"), F.lit("expanded_neighbor").alias("_reason"),
                "safe_score", "contributors", "table_element_ids", "x",
            )
        )
    rows = wanted[0]
    for other in wanted[1:]:
        rows = rows.unionByName(other)
    return rows


def _admit(steps: Column, config: ContextConfig) -> Column:
    """Fold the ordered steps of one query into an array of outcomes, one per step."""
    by_document = F.lit(config.source_diversity == "document")
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("used"), empty.alias("chunks"), empty.alias("docs"),
        empty.alias("out"),
    )

    def step(state: Column, s: Column) -> Column:
        full = (state["n"] >= config.max_items) | (state["used"] + s["tokens"] > config.max_tokens)
        outcome = (
            F.when(F.array_contains(state["chunks"], s["chunk_id"]), F.lit("deduplicated"))
            .when(by_document & F.array_contains(state["docs"], s["document_id"]), F.lit("excluded_diversity"))
            .when(full, F.lit("excluded_budget"))
            .otherwise(s["reason"])
        )
        taken = outcome == s["reason"]
        return F.struct(
            (state["n"] + taken.cast("int")).alias("n"),
            (state["used"] + F.when(taken, s["tokens"]).otherwise(0)).alias("used"),
            F.when(taken, F.array_append(state["chunks"], s["chunk_id"])).otherwise(state["chunks"]).alias("chunks"),
            F.when(taken, F.array_append(state["docs"], s["document_id"])).otherwise(state["docs"]).alias("docs"),
            F.array_append(state["out"], outcome).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda s: s["out"])


def candidate_rejects(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates whose chunk is not in their index; assemble() has no text to quote for them."""
    return candidates.join(docs.select("index_id", "chunk_id"), ["index_id", "chunk_id"], "left_anti").select(
        F.lit("candidate").alias("entity"), F.col("chunk_id").alias("id"), F.lit("chunk_exists").alias("rule"),
        F.lit("CONTEXT_INPUT_INVALID").alias("code"),
    )


def assemble(candidates: DataFrame, docs: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """One row per considered chunk: query_id, index_id, source_rank, reason, and for selected ones the item.

    A query has in an index at most a hundred candidates with five expansions each, so its fold is bounded.
    """
    base = normalize_candidates(candidates).join(
        docs.select(
            "index_id", "chunk_id", F.col("keyword_text").alias("_text"), "parent_chunk_id",
            *(["ordinal"] if config.neighbor_window else []),
            *(["hierarchy_context"] if "hierarchy_context" in docs.columns else []),
        ),
        ["index_id", "chunk_id"],
    )
    excerpt = F.substring("_text", 1, config.max_excerpt_chars)
    direct = base.select(
        "query_id", "index_id", F.lit(0).alias("_phase"), "rank", F.lit(0).alias("_step"), "chunk_id", "document_id",
        F.lit("included").alias("reason"), "safe_score", "contributors", "element_ids", "locators",
        "table_element_ids", excerpt.alias("excerpt"),
    )
    rows = direct
    if config.structural_rule != "none" and (config.expand_parent or config.neighbor_window):
        extra = _expansions(base, docs, config).select(
            "query_id", "index_id", F.lit(1).alias("_phase"), "rank", "_step", F.col("x.chunk_id").alias("chunk_id"),
            F.col("x.document_id").alias("document_id"), F.col("_reason").alias("reason"), "safe_score",
            "contributors", F.transform("x.citations", lambda c: c["element_id"]).alias("element_ids"),
            F.transform("x.citations", lambda c: c["locator"]).alias("locators"), "table_element_ids",
            F.substring("x.keyword_text", 1, config.max_excerpt_chars).alias("excerpt"),
        )
        rows = direct.unionByName(extra)
    rows = rows.withColumn("tokens", token_count(F.col("excerpt")))
    ordered = rows.groupBy("query_id", "index_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "_phase", "rank", "_step", "chunk_id", "document_id", "reason", "tokens", "safe_score",
                    F.struct("contributors", "element_ids", "locators", "table_element_ids", "excerpt").alias("item"),
                )
            ),
            lambda a, b: _compare(a, b),
        ).alias("steps")
    )
    judged = ordered.withColumn("_out", _admit(F.col("steps"), config))
    flat = judged.select("query_id", "index_id", F.posexplode(F.arrays_zip("steps", "_out")).alias("_n", "z"))
    selected = F.col("z._out") == F.col("z.steps.reason")
    item = F.col("z.steps.item")
    cited = flat.select(
        "query_id", "index_id", (F.col("_n") + 1).alias("source_rank"),
        F.col("z.steps.chunk_id").alias("chunk_id"), F.col("z.steps.document_id").alias("document_id"),
        F.col("z._out").alias("reason"), F.col("z.steps.safe_score").alias("safe_score"),
        selected.alias("selected"), F.col("z.steps.tokens").alias("tokens"),
        item["excerpt"].alias("excerpt"), item["contributors"].alias("contributors"),
        item["element_ids"].alias("element_ids"), item["locators"].alias("locators"),
        F.filter(
            item["table_element_ids"], lambda x: F.array_contains(item["element_ids"], x)
        ).alias("table_element_ids"),
    )
    return citation_ids(cited)


def _compare(a: Column, b: Column) -> Column:
    def sign(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1)

    return F.coalesce(
        *[sign(a[f], b[f]) for f in ("_phase", "rank", "_step", "chunk_id")], F.lit(0)
    )


def evidence_items(decisions: DataFrame) -> DataFrame:
    return decisions.filter("selected").drop("selected", "reason")


def evidence_shortage(
    decisions: DataFrame, queries: DataFrame, config: ContextConfig = ContextConfig()
) -> DataFrame:
    """Per query and index: what was selected and why there may be too little."""
    seen = decisions.groupBy("query_id", "index_id").agg(
        F.count_if("selected").alias("selected_items"),
        F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)).alias("selected_tokens"),
        F.bool_or(F.col("reason") == "excluded_budget").alias("_budget"),
    )
    joined = queries.select("query_id", "index_id").join(seen, ["query_id", "index_id"], "left")
    items = F.coalesce("selected_items", F.lit(0))
    reason = (
        F.when(F.col("_budget").isNull(), "no_candidates")
        .when(items == 0, "budget_exhausted")
        .when(items < config.minimum_items, "below_minimum")
        .when(F.col("_budget"), "budget_exhausted")
        .otherwise("none")
    )
    return joined.select(
        "query_id", "index_id", F.lit(config.minimum_items).alias("minimum_items"), items.alias("selected_items"),
        F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"), reason.alias("shortage"),
    )

"""Data-quality rules, conditions and routing.

Every `check_*` returns rejects (entity, id, rule, code); accepted rows are whatever has none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import locator_key
from ..functions.normal import fold_fact
from ..functions.text import token_count
from ..functions.vectors import norm
from ..schemas import SLICES


def rejects(df: DataFrame, entity: str, ident: Column, rule: Column | str, code: str) -> DataFrame:
    named = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(
        F.lit(entity).alias("entity"), ident.cast("string").alias("id"), named.alias("rule"), F.lit(code).alias("code")
    )


def _all(*frames: DataFrame) -> DataFrame:
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    return rows


def check_elements(elements: DataFrame) -> DataFrame:
    """Unique ids, gap-free order, parents before children, fields their kind needs."""
    code = "CANONICAL_INPUT_INVALID"
    kind = F.col("kind")
    has = lambda c: F.col(c).isNotNull() if c in elements.columns else F.lit(False)
    shape = (
        F.when((kind == "heading") & ~(has("text") & has("level")), "heading_fields")
        .when(kind.isin("paragraph", "caption", "code") & ~has("text"), "text_field")
        .when((kind == "list") & ~(has("ordered") & has("items")), "list_fields")
        .when((kind == "table") != has("table_id"), "table_field")
    )
    shapes = rejects(
        elements.withColumn("_r", shape).filter("_r IS NOT NULL"), "element", F.col("id"), F.col("_r"), code
    )
    twice = elements.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Order is exactly 0..n-1 when no position repeats, the least is 0 and the largest n-1.
    places = elements.groupBy("document_id", "reading_order").agg(F.count(F.lit(1)).alias("n"))
    order = places.groupBy("document_id").agg(
        F.sum("n").alias("rows"), F.max("n").alias("same"), F.min("reading_order").alias("lo"),
        F.max("reading_order").alias("hi"),
    ).filter("same > 1 OR lo <> 0 OR hi <> rows - 1")
    parents = elements.select(
        "document_id", F.col("id").alias("parent_id"), F.col("reading_order").alias("_above")
    )
    links = elements.filter(F.col("parent_id").isNotNull()).join(parents, ["document_id", "parent_id"], "left").filter(
        F.col("_above").isNull() | (F.col("_above") >= F.col("reading_order"))
    )
    return _all(
        shapes,
        rejects(twice, "element", F.col("id"), "unique_id", code),
        rejects(order, "document", F.col("document_id"), "reading_order", code),
        rejects(links, "element", F.col("id"), "earlier_parent", code),
    )


def check_table_grid(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans inside the grid, no overlap, full cover, unique cell ids, headers that are headers."""
    code = "CANONICAL_INPUT_INVALID"
    size = tables.select("document_id", F.col("id").alias("table_id"), "rows", "columns")
    sized = cells.join(size, ["document_id", "table_id"])
    outside = sized.filter(
        (F.col("row") + F.col("row_span") > F.col("rows")) | (F.col("column") + F.col("column_span") > F.col("columns"))
    )
    points = (
        cells.withColumn("_r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
        .withColumn("_c", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("column_span") - 1)))
        .groupBy("document_id", "table_id", "_r", "_c").agg(F.count(F.lit(1)).alias("n"))
    )
    cover = points.groupBy("document_id", "table_id").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("covered"))
    grid = size.join(cover, ["document_id", "table_id"], "left")
    twice = cells.groupBy("document_id", "table_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    frames = [
        rejects(outside, "cell", F.col("id"), "span_bounds", code),
        rejects(grid.filter("most > 1"), "table", F.col("table_id"), "overlap", code),
        rejects(
            grid.filter("coalesce(covered, 0) <> rows * columns"), "table", F.col("table_id"), "cover", code
        ),
        rejects(twice, "cell", F.col("id"), "unique_cell_id", code),
    ]
    if "header_cell_ids" in tables.columns:
        named = tables.select(
            "document_id", F.col("id").alias("table_id"), F.explode("header_cell_ids").alias("id")
        )
        flags = cells.filter("is_header").select("document_id", "table_id", "id")
        frames.append(
            rejects(
                named.join(flags, ["document_id", "table_id", "id"], "left_anti"), "cell", F.col("id"), "header_flag", code
            )
        )
    return _all(*frames)


def check_tables(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables and table elements match one to one, with equal locators and valid relations."""
    code = "CANONICAL_DOCUMENT_INVALID"
    owners = elements.filter("kind = 'table'").select(
        "document_id", F.col("id").alias("element_id"), F.col("table_id").alias("_table"), locator_key("locator").alias("_where")
    )
    mine = tables.select(
        "document_id", "id", "element_id", locator_key("locator").alias("_key"), "caption_element_id", "related_element_ids"
    )
    both = mine.join(owners, ["document_id", "element_id"], "full")
    captions = elements.select("document_id", F.col("id").alias("caption_element_id"), F.col("kind").alias("_kind"))
    captioned = mine.filter(F.col("caption_element_id").isNotNull()).join(
        captions, ["document_id", "caption_element_id"], "left"
    )
    related = mine.select("document_id", "id", F.explode("related_element_ids").alias("_rel"))
    known = elements.select("document_id", F.col("id").alias("_rel"))
    return _all(
        rejects(both.filter("id IS NULL"), "element", F.col("element_id"), "table_missing", code),
        rejects(both.filter("id IS NOT NULL AND NOT (_table <=> id)"), "table", F.col("id"), "table_element", code),
        rejects(both.filter("_table = id AND _key <> _where"), "table", F.col("id"), "table_locator", code),
        rejects(captioned.filter("NOT (_kind <=> 'caption')"), "table", F.col("id"), "caption_kind", code),
        rejects(mine.filter(F.array_contains("related_element_ids", F.col("element_id"))), "table", F.col("id"), "self_relation", code),
        rejects(related.join(known, ["document_id", "_rel"], "left_anti"), "table", F.col("id"), "related_exists", code),
    )


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Token counts, citations and parent/child links. Chunks form two levels: a parent that has a
    parent itself is a cycle or a third level, and both are refused."""
    code = "CANONICAL_INPUT_INVALID"
    cited = F.transform("citations", lambda c: c["element_id"])
    rule = (
        F.when(F.col("token_count") != token_count(F.col("content")), "token_count")
        .when(F.size(F.array_distinct("source_element_ids")) != F.size("source_element_ids"), "unique_sources")
        .when(F.array_sort(cited) != F.array_sort("source_element_ids"), "citation_set")
    )
    if "enrichments" in chunks.columns:
        foreign = F.exists(
            F.map_values("enrichments"), lambda v: v["source_chunk_id"] != F.col("chunk_id")
        )
        rule = F.coalesce(rule, F.when(foreign, "enrichment_provenance"))
    # All links move once, by the chunk below: what each chunk says of its children and of its parent, and which chunks are parents.
    mark = lambda kind, c, p: F.struct(F.lit(kind).alias("kind"), c.alias("c"), p.cast("string").alias("p"))
    none, none_at_all = F.lit(None), F.array().cast("array<struct<kind:string,c:string,p:string>>")
    own, above = F.col("chunk_id").cast("string"), F.col("parent_chunk_id").cast("string")
    said = F.concat(
        F.when(rule.isNotNull(), F.array(mark("own", own, rule))).otherwise(none_at_all),
        F.coalesce(F.transform("child_chunk_ids", lambda c: mark("down", c.cast("string"), own)), none_at_all),
        F.when(above.isNotNull(), F.array(mark("up", own, above), mark("parent", above, none))).otherwise(none_at_all),
    )
    rows = chunks.select("document_id", F.explode(said).alias("m")).select("document_id", "m.*").repartition("document_id", "c")
    many = lambda kind: F.count_if(F.col("kind") == kind).cast("int").alias(kind)
    links = rows.groupBy("document_id", "c", F.col("p")).agg(many("own"), many("down"), many("up"), many("parent"))
    known = F.col("document_id").isNotNull() & F.col("c").isNotNull()
    matched = known & F.col("p").isNotNull() & (F.col("down") > 0) & (F.col("up") > 0)
    below = F.sum("up").over(Window.partitionBy("document_id", "c")) > 0
    found = F.concat(
        F.array_repeat("p", F.col("own")),
        F.array_repeat(F.lit("child_without_parent"), F.when(matched, 0).otherwise(F.col("down"))),
        F.array_repeat(F.lit("parent_without_child"), F.when(matched, 0).otherwise(F.col("up"))),
        F.array_repeat(F.lit("cycle"), F.when(known & F.col("below") & (F.col("parent") > 0), 1).otherwise(0)),
    )
    broken = links.withColumn("below", below).select("c", F.explode(found).alias("_r"))
    return rejects(broken, "chunk", F.col("c"), F.col("_r"), code)


def check_embeddings(embeddings: DataFrame, dimension: int, chunks: DataFrame | None = None) -> DataFrame:
    """Finite unit vectors of one dimension, unique and aligned with the chunks."""
    code = "EMBEDDING_RECORD_INVALID"
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rule = (
        F.when(F.size(v) != dimension, "dimension").when(bad, "finite")
        .when(F.abs(norm(v) - 1) > 1e-6, "unit_norm")
    )
    twice = embeddings.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    frames = [
        rejects(embeddings.withColumn("_r", rule).filter("_r IS NOT NULL"), "embedding", F.col("chunk_id"), F.col("_r"), code),
        rejects(twice, "embedding", F.col("chunk_id"), "unique_id", code),
    ]
    if chunks is not None:
        ids = chunks.select("chunk_id")
        frames.append(rejects(ids.join(embeddings, "chunk_id", "left_anti"), "chunk", F.col("chunk_id"), "missing_embedding", code))
        frames.append(rejects(embeddings.join(ids, "chunk_id", "left_anti"), "embedding", F.col("chunk_id"), "foreign_chunk", code))
    return _all(*frames)


def check_candidates(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranks 1..n, unique ids, scores in [0, 1], citations of the named chunk, one index."""
    code = "RETRIEVAL_OUTPUT_INVALID"
    ranks = candidates.groupBy("query_id", "contributor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"),
        F.max("rank").alias("hi"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("index_id").alias("indexes"),
    )
    rule = (
        F.when((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "ranks")
        .when(F.col("chunks") != F.col("n"), "unique_chunk").when(F.col("indexes") > 1, "one_index")
    )
    scores = candidates.filter(~F.coalesce(F.col("safe_score").between(0, 1), F.lit(False)) | F.isnan("safe_score"))
    cited = candidates.select(
        "candidate_id", "index_id", "chunk_id",
        F.explode(F.arrays_zip(F.col("element_ids").alias("e"), F.col("locators").alias("l"))).alias("z"),
    ).select("candidate_id", "index_id", "chunk_id", F.col("z.e").alias("e"), locator_key("z.l").alias("k"))
    held = docs.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "index_id", "chunk_id", F.explode("citations").alias("c")
    ).select("index_id", "chunk_id", F.col("c.element_id").alias("e"), locator_key("c.locator").alias("k"))
    foreign = cited.join(held, ["index_id", "chunk_id", "e", "k"], "left_anti").select("candidate_id").distinct()
    return _all(
        rejects(ranks.withColumn("_r", rule).filter("_r IS NOT NULL"), "query", F.col("query_id"), F.col("_r"), code),
        rejects(scores, "candidate", F.col("candidate_id"), "score_range", code),
        rejects(foreign, "candidate", F.col("candidate_id"), "foreign_citation", code),
    )


# ---------------------------------------------------------------- golden dataset cases


def slice_errors(slices: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """UNKNOWN_SLICE for values outside the taxonomy, SLICE_SET_INVALID when a dimension is missing."""
    unknown, missing = F.lit(False), F.lit(False)
    for s in SLICES:
        value = slices[s]
        missing = missing | value.isNull()
        unknown = unknown | (value.isNotNull() & ~value.isin(*taxonomy.get(s, ())))
    return F.array_compact(F.array(F.when(unknown, "UNKNOWN_SLICE"), F.when(missing, "SLICE_SET_INVALID")))


def validate_annotations(
    annotations: DataFrame, elements: DataFrame, tables: DataFrame, cells: DataFrame, documents: DataFrame,
    taxonomy: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Error codes per annotation: (case_id, errors array<string>).

    Annotations: (case_id, document_id, source_digest, element_id, table_id, cell_id, start, end,
    locator_key, target_kind, slices).
    """
    docs = documents.select("document_id", F.col("content_digest").alias("_digest"))
    # An element without text is shorter than any span; one that is not found has no length.
    els = elements.select("document_id", F.col("id").alias("element_id"), F.coalesce(F.length("text"), F.lit(-1)).alias("_length"))
    tabs = tables.select("document_id", F.col("id").alias("table_id"), F.lit(True).alias("_tab"))
    cs = cells.select("document_id", "table_id", F.col("id").alias("cell_id"), F.lit(True).alias("_cell")).distinct()
    places = elements.select("document_id", locator_key("locator").alias("locator_key")).unionByName(
        tables.select("document_id", locator_key("locator").alias("locator_key"))
    ).distinct().withColumn("_place", F.lit(True))
    no = lambda flag, given: F.col(given).isNotNull() & F.col(flag).isNull()
    length = F.coalesce("_length", F.lit(-1))
    span = F.col("_span") & ((length < 0) | F.col("end").isNull() | (F.col("end") > length))
    # Slices are judged before the rows move, and after each join only what later ones need moves on.
    rows = annotations.select(
        "case_id", "document_id", "source_digest", "element_id", "table_id", "cell_id", "end", "locator_key",
        F.coalesce(F.col("target_kind") == "text_span", F.lit(False)).alias("_span"), slice_errors(F.col("slices"), taxonomy).alias("_slices"))
    kept = ["case_id", "document_id", "_slices"]
    rows = rows.join(docs, "document_id", "left").select(
        *kept, "element_id", "table_id", "cell_id", "end", "locator_key", "_span", (~F.col("_digest").eqNullSafe(F.col("source_digest"))).alias("_broken"))
    rows = rows.join(els, ["document_id", "element_id"], "left").select(
        *kept, "_broken", "table_id", "cell_id", "locator_key", F.coalesce(no("_length", "element_id") | span, F.lit(False)).alias("_bad"))
    rows = rows.join(tabs, ["document_id", "table_id"], "left").select(
        *kept, "_broken", "table_id", "cell_id", "locator_key", (F.col("_bad") | no("_tab", "table_id")).alias("_bad"))
    rows = rows.join(cs, ["document_id", "table_id", "cell_id"], "left").select(
        *kept, "_broken", "locator_key", (F.col("_bad") | no("_cell", "cell_id")).alias("_bad"))
    rows = rows.join(places, ["document_id", "locator_key"], "left")
    invalid = F.col("_bad") | no("_place", "locator_key")
    own = F.array_compact(F.array(F.when(F.col("_broken"), "DOCUMENT_REFERENCE_BROKEN").when(invalid, "LOCATOR_INVALID")))
    return rows.select("case_id", F.array_sort(F.array_distinct(F.concat("_slices", own))).alias("errors"))


def validate_query_cases(
    cases: DataFrame, documents: DataFrame, evidence: DataFrame, taxonomy: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Error codes per query case: (case_id, errors array<string>).

    Cases: (case_id, document_id, source_digest, evidence_set_id, answerability, expected_facts,
    forbidden_facts, relevant_evidence_ids, required_citation_keys, slices); evidence: (evidence_set_id,
    document_id, evidence_id, citation_key), one row per item.
    """
    docs = documents.select("document_id", F.col("content_digest").alias("_digest"))
    sets = evidence.groupBy("evidence_set_id").agg(
        F.collect_list(F.struct("evidence_id", "citation_key")).alias("_items"), F.min("document_id").alias("_ev_doc")
    )
    facts = cases.select("case_id", F.explode(F.concat(
        F.transform("expected_facts", lambda f: F.struct(f.alias("f"), F.lit("e").alias("s"))),
        F.transform("forbidden_facts", lambda f: F.struct(f.alias("f"), F.lit("x").alias("s"))),
    )).alias("v")).select("case_id", fold_fact(F.col("v.f")).alias("fact"))
    repeated = facts.groupBy("case_id", "fact").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "case_id", F.lit(True).alias("_facts")
    ).distinct()
    rows = cases.join(docs, "document_id", "left").join(sets, "evidence_set_id", "left").join(repeated, "case_id", "left")
    size = lambda c: F.size(F.col(c))
    broken_doc = ~F.col("_digest").eqNullSafe(F.col("source_digest"))
    answerable = F.col("answerability") == "answerable"
    something = (size("expected_facts") > 0) | (size("relevant_evidence_ids") > 0) | (size("required_citation_keys") > 0)
    lacking = (
        (size("expected_facts") == 0) | F.col("evidence_set_id").isNull() | (size("relevant_evidence_ids") == 0)
        | (size("required_citation_keys") == 0)
    )
    relevant = F.col("relevant_evidence_ids")
    ids = F.transform("_items", lambda i: i["evidence_id"])
    keys = F.transform(
        F.filter("_items", lambda i: F.array_contains(relevant, i["evidence_id"])), lambda i: i["citation_key"]
    )
    repeats = lambda c: F.size(F.array_distinct(c)) != size(c)
    bad_set = (
        F.col("_items").isNull() | broken_doc | ~F.col("_ev_doc").eqNullSafe(F.col("document_id"))
        | (F.size(F.array_except(relevant, ids)) > 0) | (F.size(F.array_except("required_citation_keys", keys)) > 0)
        | repeats("relevant_evidence_ids") | repeats("required_citation_keys")
    )
    bad_evidence = F.when(F.col("evidence_set_id").isNotNull(), bad_set).otherwise(
        (size("relevant_evidence_ids") > 0) | (size("required_citation_keys") > 0)
    )
    own = F.array_compact(F.array(
        F.when(broken_doc, "DOCUMENT_REFERENCE_BROKEN"), F.when(F.col("_facts"), "FACTS_INVALID"),
        F.when((answerable & lacking) | (~answerable & something), "ANSWERABILITY_CONTRADICTORY"),
        F.when(bad_evidence, "EVIDENCE_REFERENCE_BROKEN"),
    ))
    return rows.select(
        "case_id", F.array_sort(F.array_distinct(F.concat(slice_errors(F.col("slices"), taxonomy), own))).alias("errors")
    )


def case_digest(case: Column) -> Column:
    """Digest of a case's content without its reviews."""
    return F.sha2(F.to_json(case), 256)


def is_reviewed(cases: DataFrame, reviews: DataFrame, content: Sequence[str]) -> DataFrame:
    """(case_id, is_reviewed): the latest review saw exactly the current content.

    Reviews: (case_id, reviewed_at, content_digest).
    """
    latest = reviews.groupBy("case_id").agg(F.max_by("content_digest", "reviewed_at").alias("_seen"))
    return cases.withColumn("_now", case_digest(F.struct(*content))).join(latest, "case_id", "left").select(
        "case_id", F.coalesce(F.col("_seen") == F.col("_now"), F.lit(False)).alias("is_reviewed")
    )


# ---------------------------------------------------------------- conditions and routing


def condition(expression: Mapping[str, Any] | None, columns: Mapping[str, Column]) -> Column:
    """A nested all/any/not/eq/in/gte/lte expression over named observables as one Column.

    Comparisons of order are false for anything but numbers; equality treats NULL as a value.
    """
    if expression is None:
        return F.lit(True)
    (operator, operand), = expression.items()
    if operator in ("all", "any"):
        parts = [condition(p, columns) for p in operand]
        joined = F.lit(operator == "all")
        for part in parts:
            joined = joined & part if operator == "all" else joined | part
        return joined
    if operator == "not":
        return ~condition(operand, columns)
    name, value = operand
    actual = columns.get(name, F.lit(None))
    if operator == "eq":
        return actual.eqNullSafe(F.lit(value))
    if operator == "in":
        hit = F.lit(False)
        for option in value if isinstance(value, (list, tuple)) else ():
            hit = hit | actual.eqNullSafe(F.lit(option))
        return hit
    if operator in ("gte", "lte"):
        number = F.when(~F.typeof(actual).isin("string", "boolean"), actual.cast("double"))
        test = number >= F.lit(value) if operator == "gte" else number <= F.lit(value)
        return F.coalesce(test, F.lit(False))
    raise ValueError(f"unknown operator {operator}")


@dataclass(frozen=True)
class RouteRule:
    rule_id: str
    tier: str
    profile_id: str
    when: Mapping[str, Any] | None = None


def route(
    df: DataFrame, rules: Sequence[RouteRule], default: str, observables: Mapping[str, Column],
    explicit: Column | None = None, tiers: Sequence[str] = ("document_class", "preflight"),
) -> DataFrame:
    """Choose one profile per row: explicit, then tier by tier, then the default.

    Two matches in one tier are ambiguous and leave `profile_id` NULL. `evaluated` lists the rules
    looked at, up to and including the deciding tier.
    """
    unknown = {r.tier for r in rules} - set(tiers)
    if unknown:
        raise ValueError(f"unknown tiers {sorted(unknown)}")
    given = explicit if explicit is not None else F.lit(None).cast("string")
    tier_name = F.when(given.isNotNull(), F.lit("explicit"))
    profile, open_yet = given, given.isNull()
    ambiguous = F.lit(False)
    evaluated = F.array().cast("array<struct<rule_id:string,tier:string,matched:boolean>>")
    for tier in tiers:
        mine = [(r, condition(r.when, observables)) for r in rules if r.tier == tier]
        if not mine:
            continue
        hits = F.lit(0)
        for _, test in mine:
            hits = hits + test.cast("int")
        looked = F.array(*[
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(tier).alias("tier"), test.alias("matched")) for r, test in mine
        ])
        chosen = F.coalesce(*[F.when(test, F.lit(r.profile_id)) for r, test in mine])
        evaluated = F.when(open_yet, F.concat(evaluated, looked)).otherwise(evaluated)
        ambiguous = ambiguous | (open_yet & (hits > 1))
        profile = F.when(open_yet & (hits == 1), chosen).otherwise(profile)
        tier_name = F.when(open_yet & (hits >= 1), F.lit(tier)).otherwise(tier_name)
        open_yet = open_yet & (hits == 0)
    return df.select(
        "*", F.when(ambiguous, F.lit(None)).when(open_yet, F.lit(default)).otherwise(profile).alias("profile_id"),
        F.coalesce(tier_name, F.lit("default")).alias("tier"), ambiguous.alias("ambiguous"), evaluated.alias("evaluated"),
    )


# Quality statuses from best to worst.
STATUSES = ("PASS", "WARN", "FAIL")


def select_candidate(outputs: DataFrame, signals: DataFrame) -> DataFrame:
    """The first alternative output of a stage whose worst quality signal is acceptable.

    Outputs: (item_id, candidate_no, accept array<string>); signals: (item_id, candidate_no, status).
    Returns every alternative with worst status and decision `accepted`, `rejected` or `skipped`;
    items without an accepted one are exhausted.
    """
    order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    worst = signals.groupBy("item_id", "candidate_no").agg(F.max(order).alias("_w"))
    rated = outputs.join(worst, ["item_id", "candidate_no"], "left").withColumn(
        "worst", F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(F.col("_w"), F.lit(1)).cast("int"))
    ).withColumn("_ok", F.array_contains("accept", F.col("worst")))
    first = rated.filter("_ok").groupBy("item_id").agg(F.min("candidate_no").alias("_first"))
    decided = rated.join(first, "item_id", "left")
    decision = (
        F.when(F.col("candidate_no") == F.col("_first"), "accepted")
        .when(F.col("candidate_no") > F.col("_first"), "skipped").otherwise("rejected")
    )
    return decided.select("item_id", "candidate_no", "worst", decision.alias("decision"), F.col("_first").isNull().alias("exhausted"))


def check_index_binding(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs of which every row is bound to the one index pinned by the plan: (run_id, trusted).

    Rows: (run_id, index_id, index_digest) of candidates and evidence; plans: the same, one per run.
    """
    seen = rows.groupBy("run_id").agg(
        F.min(F.struct("index_id", "index_digest")).alias("_lo"), F.max(F.struct("index_id", "index_digest")).alias("_hi"),
        F.count_if(F.col("index_id").isNull() | F.col("index_digest").isNull()).alias("_open"),
    )
    pinned = plans.select("run_id", F.struct("index_id", "index_digest").alias("_pin"))
    return pinned.join(seen, "run_id").select(
        "run_id",
        ((F.col("_lo") == F.col("_hi")) & (F.col("_lo") == F.col("_pin")) & (F.col("_open") == 0)).alias("trusted"),
    )

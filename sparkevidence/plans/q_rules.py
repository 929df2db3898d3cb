"""Registered queries: data-quality rules, conditions, routing, dataset cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..schemas import SLICES, locator
from ..sources import datasets as D
from . import bindings as B
from . import q_evidence as X
from . import q_chunks, q_metrics  # noqa: F401 - their SQL pieces are used below
from .registry import piece, query, with_pieces


def _rows(df):
    return df.select("entity", "id", "rule")


def broken_elements(t):
    pos, missing = F.col("reading_order"), F.lit(None)
    rows = B.tree_elements(t).select(
        "document_id", "id", "kind", "reading_order",
        F.when(pos % 301 == 2, "missing").alias("parent_id"),
        F.when(pos % 101 == 7, missing).otherwise(F.col("level")).alias("level"),
        F.when(pos % 97 == 13, missing).otherwise(F.col("text")).alias("text"),
        missing.cast("string").alias("table_id"), "locator",
    )
    return rows.unionByName(rows.filter("reading_order % 211 = 43"))


piece(
    "bad_el",
    "SELECT document_id, pos, id, kind, CASE WHEN pos % 301 = 2 THEN 'missing' END AS parent_id, CASE WHEN pos % 101 = 7 THEN NULL ELSE "
    "level END AS level, CASE WHEN pos % 97 = 13 THEN NULL ELSE text END AS text FROM tree_in",
    "tree_in",
)
piece("bad_el2", "SELECT * FROM bad_el UNION ALL SELECT * FROM bad_el WHERE pos % 211 = 43", "bad_el")


@query(
    "check_elements",
    with_pieces("bad_el2")
    + "SELECT 'element' AS entity, id, CASE WHEN kind = 'heading' THEN 'heading_fields' ELSE 'text_field' END AS rule FROM bad_el2 WHERE text "
    "IS NULL OR (kind = 'heading' AND level IS NULL) UNION ALL SELECT 'element', id, 'unique_id' FROM bad_el2 GROUP BY document_id, id HAVING "
    "count(*) > 1 UNION ALL SELECT 'document', document_id, 'reading_order' FROM bad_el2 GROUP BY document_id HAVING count(*) <> "
    "count(DISTINCT pos) OR min(pos) <> 0 OR max(pos) <> count(*) - 1 UNION ALL SELECT 'element', id, 'earlier_parent' FROM bad_el2 WHERE "
    "parent_id IS NOT NULL",
)
def check_elements(t):
    return _rows(R.check_elements(broken_elements(t)))


def broken_grid(t):
    """Order lines as cells: spans from quantity and part, so they overlap, leave gaps and overrun."""
    key = F.col("l_orderkey").cast("string")
    cells = t.lineitem.select(
        F.concat(F.lit("ord-"), key).alias("document_id"), F.concat(F.lit("grid-"), key).alias("table_id"),
        F.concat_ws("-", F.lit("g"), key, F.col("l_linenumber"), F.col("l_partkey") % 3).alias("id"),
        (F.col("l_linenumber") - 1).alias("row"), F.lit(0).alias("column"),
        (1 + F.col("l_quantity").cast("int") % 2).alias("row_span"),
        (1 + F.col("l_partkey") % 2).cast("int").alias("column_span"), (F.col("l_returnflag") == "A").alias("is_header"),
    )
    tables = t.orders.select(
        F.concat(F.lit("ord-"), "o_orderkey").alias("document_id"), F.concat(F.lit("grid-"), "o_orderkey").alias("id"),
        F.lit(7).alias("rows"), F.lit(2).alias("columns"),
        F.array(F.concat(F.lit("g-"), F.col("o_orderkey"), F.lit("-1-0"))).alias("header_cell_ids"),
    )
    return cells, tables


piece(
    "grid",
    "SELECT l_orderkey AS ok, 'g-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey % 3 AS id, l_linenumber - 1 AS r, 1 + "
    "l_quantity::INT % 2 AS rs, 1 + l_partkey % 2 AS cs, l_returnflag = 'A' AS h FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
)
piece(
    "grid_points",
    "SELECT ok, rr, cc, count(*) AS n FROM (SELECT ok, rr, unnest(range(0, cs)) AS cc FROM (SELECT *, unnest(range(r, r + rs)) AS rr FROM "
    "grid)) GROUP BY ALL",
    "grid",
)


@query(
    "check_table_grid",
    with_pieces("grid", "grid_points")
    + "SELECT 'cell' AS entity, id, 'span_bounds' AS rule FROM grid WHERE r + rs > 7 OR cs > 2 UNION ALL SELECT 'table', 'grid-' || ok, "
    "'overlap' FROM grid_points GROUP BY ok HAVING max(n) > 1 UNION ALL SELECT 'table', 'grid-' || o_orderkey, 'cover' FROM orders WHERE "
    "coalesce((SELECT count(*) FROM grid_points g WHERE g.ok = o_orderkey), 0) <> 14 UNION ALL SELECT 'cell', id, 'unique_cell_id' FROM grid "
    "GROUP BY ok, id HAVING count(*) > 1 UNION ALL SELECT 'cell', 'g-' || o_orderkey || '-1-0', 'header_flag' FROM orders WHERE NOT EXISTS "
    "(SELECT 1 FROM grid g WHERE g.id = 'g-' || o_orderkey || '-1-0' AND g.h)",
)
def check_table_grid(t):
    return _rows(R.check_table_grid(*broken_grid(t)))


def broken_tables(t):
    key = F.regexp_extract("id", r"-(\d+)", 1).cast("long")
    text = key.cast("string")
    other = locator(kind=F.lit("spreadsheet"), sheet_name=F.lit("orders"), range=F.lit("B3"))
    return B.sheet_tables(t).filter(key % 17 != 0).select(
        "document_id", "id", "element_id", "rows", "columns",
        F.when(key % 7 == 0, F.concat(F.lit("n-"), text)).otherwise(F.col("caption_element_id")).alias("caption_element_id"),
        F.when(key % 13 == 0, F.array("element_id")).when(key % 19 == 0, F.array(F.lit("nowhere")))
        .otherwise(F.col("related_element_ids")).alias("related_element_ids"),
        F.when(key % 11 == 0, other).otherwise(F.col("locator")).alias("locator"),
    )


@query(
    "check_tables",
    "WITH k AS (SELECT DISTINCT o_custkey AS ck FROM orders), l AS (SELECT * FROM k WHERE ck % 17 <> 0) SELECT 'element' AS entity, 't-' || ck AS "
    "id, 'table_missing' AS rule FROM k WHERE ck % 17 = 0 UNION ALL SELECT 'table', 'tbl-' || ck, 'table_locator' FROM l WHERE ck % 11 = 0 UNION "
    "ALL SELECT 'table', 'tbl-' || ck, 'caption_kind' FROM l WHERE ck % 7 = 0 UNION ALL SELECT 'table', 'tbl-' || ck, 'self_relation' FROM l WHERE "
    "ck % 13 = 0 UNION ALL SELECT 'table', 'tbl-' || ck, 'related_exists' FROM l WHERE ck % 19 = 0 AND ck % 13 <> 0",
)
def check_tables(t):
    return _rows(R.check_tables(B.sheet_elements(t), broken_tables(t)))


def broken_chunks(t):
    ids = F.col("source_element_ids")
    none = F.array().cast("array<string>")
    return B.chunks(t).select(
        "document_id", "chunk_id", "content", "citations",
        F.when(F.col("start") % 5 == 4, F.col("token_count") + 1).otherwise(F.col("token_count")).alias("token_count"),
        F.when(F.col("start") % 7 == 3, F.concat(ids, F.slice(ids, 1, 1))).otherwise(ids).alias("source_element_ids"),
        F.when(F.col("start") % 13 == 6, "ghost-parent").alias("parent_chunk_id"),
        F.when(F.col("start") % 11 == 5, F.array(F.concat(F.lit("ghost-"), "chunk_id"))).otherwise(none).alias("child_chunk_ids"),
    )


@query(
    "check_chunks",
    with_pieces("fx_chunks")
    + "SELECT 'chunk' AS entity, chunk_id AS id, CASE WHEN start % 5 = 4 THEN 'token_count' ELSE 'unique_sources' END AS rule FROM fx_chunks WHERE "
    "start % 5 = 4 OR start % 7 = 3 UNION ALL SELECT 'chunk', 'ghost-' || chunk_id, 'child_without_parent' FROM fx_chunks WHERE start % 11 = 5 "
    "UNION ALL SELECT 'chunk', chunk_id, 'parent_without_child' FROM fx_chunks WHERE start % 13 = 6",
)
def check_chunks(t):
    return _rows(R.check_chunks(broken_chunks(t)))


def broken_embeddings(t):
    v = F.col("embedding").cast("array<double>")
    n = F.col("vec_id")
    changed = F.when(n % 17 == 2, F.slice(v, 1, 63)).when(n % 10 == 3, F.transform(v, lambda x: x * 1.5)).otherwise(v)
    rows = t.embeddings.select(n.cast("string").alias("chunk_id"), changed.alias("embedding"))
    chunks = t.embeddings.filter("vec_id % 29 <> 1").select(n.cast("string").alias("chunk_id")).unionByName(
        t.embeddings.filter("vec_id % 31 = 0").select((n + 1000000).cast("string").alias("chunk_id"))
    )
    return rows.unionByName(rows.filter("chunk_id % 23 = 5")), chunks


@query(
    "check_embeddings",
    "WITH e AS (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 23 = 5) SELECT 'embedding' AS entity, "
    "vec_id::VARCHAR AS id, CASE WHEN vec_id % 17 = 2 THEN 'dimension' ELSE 'unit_norm' END AS rule FROM e WHERE vec_id % 17 = 2 OR vec_id % 10 = 3 "
    "UNION ALL SELECT 'embedding', vec_id::VARCHAR, 'unique_id' FROM embeddings WHERE vec_id % 23 = 5 UNION ALL SELECT 'embedding', "
    "vec_id::VARCHAR, 'foreign_chunk' FROM e WHERE vec_id % 29 = 1 UNION ALL SELECT 'chunk', (vec_id + 1000000)::VARCHAR, 'missing_embedding' FROM "
    "embeddings WHERE vec_id % 31 = 0",
)
def check_embeddings(t):
    rows, chunks = broken_embeddings(t)
    return _rows(R.check_embeddings(rows, 64, chunks))


def broken_candidates(t):
    n = F.regexp_extract("query_id", r"-(\d+)", 1).cast("int")
    return X.keyword_set(t).withColumns({
        "rank": F.when(n % 5 == 0, F.col("rank") + 1).otherwise(F.col("rank")),
        "safe_score": F.when((n % 7 == 0) & (F.col("safe_score") == 1), 2.0).otherwise(F.col("safe_score")),
        "element_ids": F.when((n % 3 == 0) & (F.col("safe_score") == 1), F.transform("element_ids", lambda e: F.lit("x")))
        .otherwise(F.col("element_ids")),
    })


@query(
    "check_candidates",
    with_pieces("kw_ranked")
    + ", c AS (SELECT query_id, split_part(query_id, '-', 2)::INT AS n, " + B.sql_id("cnd", "'corpus'", "'keyword'", "chunk_id")
    + " AS id, safe_score FROM kw_ranked) SELECT DISTINCT 'query' AS entity, query_id AS id, 'ranks' AS rule FROM c WHERE n % 5 = 0 UNION ALL "
    "SELECT 'candidate', id, 'score_range' FROM c WHERE n % 7 = 0 AND safe_score = 1 UNION ALL SELECT DISTINCT 'candidate', id, "
    "'foreign_citation' FROM c WHERE n % 3 = 0 AND safe_score = 1",
)
def check_candidates(t):
    return _rows(R.check_candidates(broken_candidates(t), B.lexical_docs(t)))


# ---------------------------------------------------------------- golden dataset cases

TAXONOMY = {s: ("any",) for s in SLICES} | {"language": ("en", "other"), "criticality": ("high", "low")}


def _slices(number):
    given = {
        "language": F.when(number % 9 == 0, "xx").otherwise("en"),
        "criticality": F.when(number % 10 == 0, F.lit(None)).otherwise("low"),
    }
    return F.struct(*[given.get(s, F.lit("any")).alias(s) for s in SLICES])


def dataset_cases(t):
    n = F.col("conv_id")
    key = n.cast("string")
    said = F.coalesce(F.get(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) > 1), F.lit(0)), F.lit("zz"))
    # A fact of each turn: its first word, under the turn's number.
    told = t.conversations.select("conv_id", "turn", F.concat(F.lit("t"), "turn", F.lit(" "), said).alias("fact"))
    first = told.groupBy("conv_id").agg(
        F.min("turn").cast("string").alias("_turn"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "fact"))), lambda x: x["fact"]).alias("_facts"))
    none = F.array().cast("array<string>")
    ev, ck = F.concat_ws("-", F.lit("ev"), key, "_turn"), F.concat_ws("-", F.lit("ck"), key, "_turn")
    return first.select(
        F.concat(F.lit("conv-"), key).alias("case_id"), F.concat(F.lit("conv-"), key).alias("document_id"),
        F.concat(F.lit("conv-"), key).alias("source_id"),
        F.when(n % 5 == 0, "zz").otherwise(F.concat(F.lit("d"), key)).alias("source_digest"),
        F.when(n % 6 != 0, F.concat(F.lit("es-"), key)).alias("evidence_set_id"),
        F.when(n % 6 != 0, F.concat(F.lit("es-"), key)).alias("evidence_id"),
        F.when(n % 11 == 0, "ambiguous").otherwise("answerable").alias("answerability"),
        F.when(n % 4 == 0, F.concat("_facts", F.transform("_facts", F.upper))).otherwise(F.col("_facts")).alias("expected_facts"), none.alias("forbidden_facts"),
        F.when(n % 7 == 0, F.array(ev, ev)).otherwise(F.array(ev)).alias("relevant_evidence_ids"),
        F.when(n % 8 == 0, F.array(F.concat(F.lit("ck-"), key, F.lit("-9")))).otherwise(F.array(ck)).alias("required_citation_keys"),
        _slices(n).alias("slices"),
    )


def dataset_inputs(t):
    key = F.col("conv_id").cast("string")
    docs = t.conversations.select("conv_id").distinct().select(
        F.concat(F.lit("conv-"), key).alias("document_id"), F.concat(F.lit("d"), key).alias("content_digest")
    )
    evidence = t.conversations.filter("role <> 'assistant'").select(
        F.concat(F.lit("es-"), key).alias("evidence_set_id"), F.concat(F.lit("conv-"), key).alias("document_id"),
        F.concat_ws("-", F.lit("ev"), key, "turn").alias("evidence_id"), F.concat_ws("-", F.lit("ck"), key, "turn").alias("citation_key"),
    )
    return docs, evidence


def query_errors(t):
    docs, evidence = dataset_inputs(t)
    return R.validate_query_cases(dataset_cases(t), docs, evidence, TAXONOMY)


piece(
    "qc_err",
    "SELECT 'conv-' || n AS case_id, list_sort(list_filter([CASE WHEN n % 9 = 0 THEN 'UNKNOWN_SLICE' END, CASE WHEN n % 10 = 0 THEN "
    "'SLICE_SET_INVALID' END, CASE WHEN n % 5 = 0 THEN 'DOCUMENT_REFERENCE_BROKEN' END, CASE WHEN n % 4 = 0 THEN 'FACTS_INVALID' END, CASE WHEN "
    "n % 11 = 0 OR n % 6 = 0 THEN 'ANSWERABILITY_CONTRADICTORY' END, CASE WHEN n % 6 = 0 OR n % 5 = 0 OR n % 7 = 0 OR n % 8 = 0 OR NOT user0 THEN "
    "'EVIDENCE_REFERENCE_BROKEN' END], lambda x: x IS NOT NULL)) AS errors, n FROM (SELECT conv_id AS n, arg_min(role, turn) <> "
    "'assistant' AS user0 FROM conversations GROUP BY 1)",
)


@query(
    "validate_query_cases",
    with_pieces("qc_err") + "SELECT case_id, array_to_string(errors, ',') AS errors FROM qc_err",
)
def validate_query_cases(t):
    return query_errors(t).withColumn("errors", F.array_join("errors", ","))


def annotations(t):
    pos = F.col("reading_order")
    number = F.regexp_extract("document_id", r"-(\d+)", 1).cast("long")
    none = F.lit(None).cast("string")
    spans = B.tree_elements(t).select(
        F.concat(F.lit("a-"), "id").alias("case_id"), "document_id", F.lit("digest").alias("source_digest"),
        F.when(pos % 31 == 2, "missing").otherwise(F.col("id")).alias("element_id"), none.alias("table_id"), none.alias("cell_id"),
        (F.length("text") + F.when(pos % 20 == 4, 5).otherwise(0)).alias("end"), none.alias("locator_key"),
        F.lit("text_span").alias("target_kind"), _slices(number).alias("slices"),
    )
    cells = B.sheet_cells(t).select(
        F.concat(F.lit("a-"), "id").alias("case_id"), "document_id", F.lit("digest").alias("source_digest"), none.alias("element_id"),
        "table_id", F.when(F.col("row") % 4 == 1, "ghost").otherwise(F.col("id")).alias("cell_id"), F.lit(None).cast("int").alias("end"),
        F.when(F.col("column") == 2, '{"kind":"nowhere"}').alias("locator_key"), F.lit("cell").alias("target_kind"),
        _slices(F.lit(1)).alias("slices"),
    )
    return spans.unionByName(cells)


@query(
    "validate_annotations",
    with_pieces("tree_in", "sheet_cells_in")
    + ", a AS (SELECT 'a-' || id AS case_id, split_part(document_id, '-', 2)::INT AS n, pos % 31 = 2 OR pos % 20 = 4 AS bad, "
    "split_part(document_id, '-', 2)::INT % 13 = 0 AS stale FROM tree_in UNION ALL SELECT 'a-cel-' || ck || '-' || r || '-' || c, 1, r % 4 = 1 OR c "
    "= 2, ck % 13 = 0 FROM sheet_cells_in) SELECT case_id, array_to_string(list_sort(list_filter([CASE WHEN n % 9 = 0 THEN 'UNKNOWN_SLICE' END, "
    "CASE WHEN n % 10 = 0 THEN 'SLICE_SET_INVALID' END, CASE WHEN stale THEN 'DOCUMENT_REFERENCE_BROKEN' WHEN bad THEN 'LOCATOR_INVALID' END], "
    "lambda x: x IS NOT NULL)), ',') AS errors FROM a",
)
def validate_annotations(t):
    number = F.col("c_custkey")
    stale = F.when(number % 13 == 0, "old").otherwise("digest")
    docs = t.customer.select(F.concat(F.lit("cust-"), number).alias("document_id"), stale.alias("content_digest")).unionByName(
        t.customer.select(F.concat(F.lit("sheet-"), number).alias("document_id"), stale.alias("content_digest"))
    )
    shape = ["document_id", "id", "text", "locator"]
    elements = B.tree_elements(t).select(*shape).unionByName(B.sheet_elements(t).select(*shape))
    found = R.validate_annotations(
        annotations(t), elements, B.sheet_tables(t), B.sheet_cells(t), docs, TAXONOMY
    )
    return found.withColumn("errors", F.array_join("errors", ","))


def label_reviews(t):
    """An early review of the true label and, on every third id, a later one of another label."""
    seen = lambda q: F.sha2(F.to_json(F.struct("case_id", q.alias("quality"))), 256)
    cases = t.labels.select(F.concat(F.lit("doc-"), "doc_id").alias("case_id"), "quality", "doc_id")
    early = cases.select("case_id", F.lit(1).alias("reviewed_at"), seen(F.col("quality")).alias("content_digest"))
    late = cases.filter("doc_id % 3 = 0").select("case_id", F.lit(2).alias("reviewed_at"), seen(1 - F.col("quality")).alias("content_digest"))
    return cases, early.filter("case_id NOT LIKE '%7'").unionByName(late)


@query(
    "is_reviewed",
    "SELECT 'doc-' || doc_id AS case_id, doc_id % 3 <> 0 AND doc_id % 10 <> 7 AS is_reviewed FROM labels",
)
def is_reviewed(t):
    cases, reviews = label_reviews(t)
    return R.is_reviewed(cases, reviews, ["case_id", "quality"])


def snapshot(t):
    reviewed = dataset_cases(t).select("case_id", (F.length("case_id") % 2 == 0).alias("is_reviewed"))
    return D.snapshot_parents(dataset_cases(t), query_errors(t), reviewed)


@query(
    "snapshot_parents",
    with_pieces("qc_err")
    + "SELECT case_id AS artifact_id FROM qc_err UNION SELECT 'es-' || n FROM qc_err WHERE n % 6 <> 0",
)
def snapshot_parents(t):
    return snapshot(t)[0]


@query(
    "snapshot_blocking",
    with_pieces("qc_err")
    + "SELECT case_id AS id, 'invalid' AS rule FROM qc_err WHERE len(errors) > 0 UNION ALL SELECT case_id, 'unreviewed' FROM qc_err WHERE "
    "length(case_id) % 2 <> 0",
)
def snapshot_blocking(t):
    return snapshot(t)[1].select("id", "rule")


@query(
    "label_pin_rejects",
    "SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 OR doc_id % 10 = 7 THEN 'not_reviewed' ELSE 'pin_mismatch' END AS rule FROM labels "
    "WHERE doc_id % 3 = 0 OR doc_id % 10 = 7 OR doc_id % 4 = 1",
)
def label_pin_rejects(t):
    from ..operators.aggregates import label_pin_rejects as pins

    cases, reviews = label_reviews(t)
    bound = cases.withColumns({
        "source_id": F.col("case_id"), "source_digest": F.lit("s"), "evidence_id": F.col("case_id"), "evidence_digest": F.lit("e"),
        "slices": _slices(F.lit(1)),
    })
    drifted = bound.withColumn("evidence_digest", F.when(F.col("doc_id") % 4 == 1, "other").otherwise(F.lit("e")))
    return pins(drifted, bound, R.is_reviewed(cases, reviews, ["case_id", "quality"])).select("id", "rule")


# ---------------------------------------------------------------- conditions, routing, fallback

WHEN = {
    "any": [
        {"all": [{"eq": ["event_type", "click"]}, {"gte": ["value", 10]}]},
        {"all": [{"in": ["event_type", ["error", "signup"]]}, {"not": {"lte": ["value", 5.5]}}]},
        {"gte": ["event_type", 1]},
        {"eq": ["absent", None]},
    ]
}
STRICT = {"any": WHEN["any"][:3]}


@query(
    "condition",
    "SELECT event_id, (event_type = 'click' AND value >= 10) OR (event_type IN ('error', 'signup') AND NOT value <= 5.5) AS strict, TRUE AS wide "
    "FROM events",
)
def conditions(t):
    seen = {"event_type": F.col("event_type"), "value": F.col("value")}
    return t.events.select("event_id", R.condition(STRICT, seen).alias("strict"), R.condition(WHEN, seen).alias("wide"))


RULES = (
    R.RouteRule("class-long", "document_class", "profile-long", {"eq": ["document_class", "long"]}),
    R.RouteRule("pre-en", "preflight", "profile-en", {"eq": ["lang", "en"]}),
    R.RouteRule("pre-src", "preflight", "profile-src", {"in": ["source", ["src1", "src2"]]}),
)


@query(
    "route_documents",
    "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'mine' WHEN n_chars > 2000 THEN 'profile-long' WHEN lang = 'en' AND source IN ('src1', 'src2') "
    "THEN '' WHEN lang = 'en' THEN 'profile-en' WHEN source IN ('src1', 'src2') THEN 'profile-src' ELSE 'standard' END AS profile_id, CASE WHEN "
    "doc_id % 50 = 0 THEN 'explicit' WHEN n_chars > 2000 THEN 'document_class' WHEN lang = 'en' OR source IN ('src1', 'src2') THEN 'preflight' ELSE "
    "'default' END AS tier, doc_id % 50 <> 0 AND n_chars <= 2000 AND lang = 'en' AND source IN ('src1', 'src2') AS ambiguous, CASE WHEN doc_id % 50 "
    "= 0 THEN 0 WHEN n_chars > 2000 THEN 1 ELSE 3 END AS evaluated FROM documents",
)
def route_documents(t):
    seen = {
        "document_class": F.when(F.col("n_chars") > 2000, "long").otherwise("short"), "lang": F.col("lang"), "source": F.col("source"),
    }
    out = R.route(t.documents, RULES, "standard", seen, F.when(F.col("doc_id") % 50 == 0, "mine"))
    return out.select(
        "doc_id", F.coalesce("profile_id", F.lit("")).alias("profile_id"), "tier", "ambiguous", F.size("evaluated").alias("evaluated")
    )


def stage_outputs(t):
    accept = [("PASS",), ("PASS", "WARN"), ("PASS",)]
    options = F.array(*[
        F.struct(F.lit(i + 1).alias("candidate_no"), F.array(*map(F.lit, a)).alias("accept")) for i, a in enumerate(accept)
    ])
    outputs = t.orders.select(F.col("o_orderkey").alias("item_id"), F.explode(options).alias("o")).select("item_id", "o.*")
    status = F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "A", "WARN").otherwise("FAIL")
    signals = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("candidate_no"), status.alias("status")
    )
    return outputs, signals


@query(
    "select_candidate",
    "WITH w AS (SELECT o_orderkey AS item_id, c AS candidate_no, coalesce((SELECT max(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) "
    "FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 3 + 1 = c), 1) AS worst FROM orders CROSS JOIN range(1, 4) r(c)), f AS (SELECT "
    "*, min(CASE WHEN worst = 1 OR (worst = 2 AND candidate_no = 2) THEN candidate_no END) OVER (PARTITION BY item_id) AS first FROM w) SELECT "
    "item_id, candidate_no, CASE worst WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS worst, CASE WHEN candidate_no = first THEN "
    "'accepted' WHEN candidate_no > first THEN 'skipped' ELSE 'rejected' END AS decision, first IS NULL AS exhausted FROM f",
)
def select_candidate(t):
    return R.select_candidate(*stage_outputs(t))


@query(
    "check_index_binding",
    "SELECT user_id AS run_id, user_id % 5 <> 0 AND count(*) FILTER (user_id % 7 = 0 AND event_id % 100 = 3) = 0 AS trusted FROM events GROUP BY "
    "user_id",
)
def check_index_binding(t):
    stray = (F.col("user_id") % 7 == 0) & (F.col("event_id") % 100 == 3)
    rows = t.events.select(
        F.col("user_id").alias("run_id"), F.when(stray, "other").otherwise("idx").alias("index_id"), F.lit("d").alias("index_digest")
    )
    plans = t.events.select(F.col("user_id").alias("run_id")).distinct().select(
        "run_id", F.lit("idx").alias("index_id"), F.when(F.col("run_id") % 5 == 0, "x").otherwise("d").alias("index_digest")
    )
    return R.check_index_binding(rows, plans)

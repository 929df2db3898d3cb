"""Registered queries: heading hierarchy, layout, structure counts, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from . import bindings as B
from .registry import piece, query, with_pieces

# Parent by definition: the latest earlier heading of a lower level number (any heading for text).
piece(
    "tree_top",
    "SELECT e.*, greatest(coalesce(CASE WHEN lv > 1 THEN q1 END, -1), coalesce(CASE WHEN lv > 2 THEN q2 END, -1), "
    "coalesce(CASE WHEN lv > 3 THEN q3 END, -1), coalesce(CASE WHEN lv > 4 THEN q4 END, -1)) AS top FROM ("
    "SELECT *, CASE WHEN kind = 'heading' THEN level ELSE 10 END AS lv, "
    + ", ".join(
        f"lag(p{n}) OVER (PARTITION BY document_id ORDER BY pos) AS q{n}" for n in range(1, 5)
    ) + " FROM tree_seen) e",
    "tree_seen",
)
piece(
    "tree_parent",
    "SELECT e.document_id, e.pos, e.kind, e.level, e.id, e.text, h.id AS parent_id, h.level AS parent_level "
    "FROM tree_top e LEFT JOIN tree_in h ON h.document_id = e.document_id AND h.pos = e.top",
    "tree_top", "tree_in",
)
piece(
    "tree_bad",
    "SELECT DISTINCT document_id FROM tree_parent WHERE kind = 'heading' AND level > parent_level + 1",
    "tree_parent",
)


@query(
    "heading_hierarchy",
    with_pieces("tree_parent", "tree_bad")
    + "SELECT document_id, pos AS reading_order, kind, id, parent_id FROM tree_parent "
    "WHERE document_id NOT IN (SELECT document_id FROM tree_bad)",
)
def heading_hierarchy(t):
    return S.heading_hierarchy(B.tree_elements(t)).select("document_id", "reading_order", "kind", "id", "parent_id")


@query("heading_hierarchy_rejects", with_pieces("tree_bad") + "SELECT document_id AS id, 'heading_level_skip' AS rule FROM tree_bad")
def heading_hierarchy_rejects(t):
    return S.hierarchy_rejects(B.tree_elements(t)).select("id", "rule")


@query(
    "heading_path",
    with_pieces("tree_path")
    + "SELECT document_id, pos AS reading_order, array_to_string(path, ' > ') AS path, len(path) AS depth FROM tree_path",
)
def heading_path(t):
    return S.heading_path(B.tree_elements(t)).select(
        "document_id", "reading_order", F.array_join("hierarchy_context", " > ").alias("path"),
        F.size("hierarchy_context").alias("depth"),
    )


def layout_elements(t):
    """Events as scattered marks on pages: page by user day, position by value."""
    return t.events.select(
        F.concat(F.lit("usr-"), "user_id").alias("document_id"),
        F.concat(F.lit("ev-"), "event_id").alias("id"),
        F.col("event_id").alias("reading_order"),
        F.lit(None).cast("string").alias("parent_id"),
        F.when(F.col("event_type") == "signup", "html").otherwise("pdf").alias("loc"),
        F.dayofmonth("ts").alias("page"), "value", F.col("event_type").alias("text"),
    )


_LAYOUT = (
    "WITH e AS (SELECT 'usr-' || user_id AS document_id, 'ev-' || event_id AS id, event_id, day(ts) AS page, "
    "round(value % 10 / 10, 6) AS y0, round(value % 7 / 7, 6) AS x0 FROM events) "
)


@query(
    "layout_order",
    _LAYOUT + "SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY page, y0, x0, event_id) - 1 "
    "AS reading_order FROM e",
)
def layout_order(t):
    from ..schemas import locator

    elements = layout_elements(t).withColumn(
        "locator",
        locator(
            kind=F.lit("pdf"), page_number=F.col("page"),
            y0=F.round(F.col("value") % 10 / 10, 6), x0=F.round(F.col("value") % 7 / 7, 6),
        ),
    )
    return S.layout_order(elements).select("document_id", "id", "reading_order")


@query(
    "structure_metrics",
    with_pieces("tree_parent", "tree_bad")
    + "SELECT document_id, count(*) AS elements, count(parent_id) AS hierarchy_links, 0 AS tables FROM tree_parent "
    "WHERE document_id NOT IN (SELECT document_id FROM tree_bad) GROUP BY document_id",
)
def structure_metrics(t):
    return S.structure_metrics(S.heading_hierarchy(B.tree_elements(t)))


@query(
    "detect_languages",
    "SELECT 'conv-' || conv_id AS document_id, CASE WHEN bool_or(role = 'system') THEN 'la' ELSE coalesce(nullif("
    "concat_ws(',', CASE WHEN bool_or(regexp_matches(text, '[A-Za-z]')) THEN 'en' END, "
    "CASE WHEN bool_or(regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')) THEN 'zh' END), ''), 'und') END AS languages "
    "FROM conversations GROUP BY conv_id",
)
def detect_languages(t):
    turns = t.conversations.select(
        F.concat(F.lit("conv-"), "conv_id").alias("document_id"), "text",
        F.when(F.col("role") == "system", "la").alias("language"),
    )
    return S.detect_languages(turns)

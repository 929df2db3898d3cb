"""Registered queries: tokens, rendering, the chunk strategies, enrichment, chunk counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_count as tokens_of
from ..operators import chunking as C
from ..sources.elements import elements_from_pages
from . import bindings as B
from .registry import piece, query, with_pieces

OVERLAP = C.ChunkConfig("fixed", 256, 64)
SECTIONS = C.ChunkConfig("hierarchy", 24)
FAMILIES = C.ChunkConfig("parent_child", 20, 0, 4)
SMALL_FAMILIES = C.ChunkConfig("parent_child", 40, 0, 3)
SHEETS = C.ChunkConfig("table", 40)


@query("token_count", f"SELECT doc_id, len({B.sql_words('text')}) AS tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", tokens_of(F.col("text")).alias("tokens"))


@query(
    "render_elements",
    "SELECT doc_id AS id, content FROM (SELECT doc_id, string_agg(repeat('  ', ((i - 1) % 3)::INT) || '- ' || line, "
    "chr(10) ORDER BY i) AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY doc_id)",
)
def render_elements(t):
    items = F.transform(
        F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), (i % 3).alias("level"))
    )
    lists = t.documents.select(
        F.col("doc_id").alias("id"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("text"),
        items.alias("items"),
    )
    return C.render_elements(lists).select("id", "content")


B.chunk_pieces("ov", OVERLAP)


@query(
    "chunk_overlap",
    with_pieces("ov_chunks")
    + "SELECT document_id, start, chunk_id, content, n_elements, token_count FROM ov_chunks",
)
def chunk_overlap(t):
    return B.chunks(t, OVERLAP).select(
        "document_id", "start", "chunk_id", "content", F.size("source_element_ids").alias("n_elements"), "token_count"
    )


def document_elements(t):
    return elements_from_pages(B.document_pages(t), "pages", B.ELEMENT_WORDS).withColumn(
        "level", F.lit(None).cast("int")
    )


@query(
    "chunk_overlap_from_elements",
    with_pieces("ov_chunks")
    + "SELECT document_id, start, chunk_id, content, n_elements, token_count FROM ov_chunks",
)
def chunk_overlap_from_elements(t):
    """The same chunks from an element table; blocks are short here, so documents span several."""
    made = C.chunk(document_elements(t), OVERLAP, block=256)
    return made.select(
        "document_id", "start", "chunk_id", "content", F.size("source_element_ids").alias("n_elements"), "token_count"
    )


@query(
    "elements_from_pages",
    with_pieces("elements_in")
    + "SELECT document_id, pos AS reading_order, page AS page_number, text FROM elements_in",
)
def pages_to_elements(t):
    return document_elements(t).select(
        "document_id", "reading_order", F.col("locator.page_number").alias("page_number"), "text"
    )


def grouped_tree(tag: str, segments: str, config: C.ChunkConfig, keys: str, offset: str) -> None:
    """Piece `{tag}_chunks` for tree segments (document_id, section, pos, abs, text, id, tokens)."""
    B.pack_pieces(tag, segments, config.max_tokens, config.overlap_tokens, keys)
    on = " AND ".join(f"e.{c.strip()} = g.{c.strip()}" for c in keys.split(","))
    piece(
        f"{tag}_chunks",
        "SELECT *, " + B.sql_id("chk", "document_id", f"'{config.identity}'", "ids", "''", "content")
        + f" AS chunk_id FROM (SELECT g.document_id, g.s + {offset} AS start, string_agg(e.text, chr(10) ORDER BY e.pos) "
        "AS content, string_agg(e.id, ',' ORDER BY e.pos) AS ids, sum(e.tokens) AS token_count, "
        f"arg_min(e.path, e.pos) AS path FROM {tag}_groups g JOIN {segments} e ON {on} AND e.pos >= g.s AND "
        f"e.pos < g.stop GROUP BY ALL)",
        f"{tag}_groups", segments,
    )


piece(
    "tree_seg",
    f"SELECT document_id, pos AS abs, text, id, array_to_string(path, ' > ') AS path, len({B.sql_words('text')}) AS tokens "
    "FROM tree_path",
    "tree_path",
)
piece(
    "tree_sec",
    "SELECT *, abs - section AS pos FROM (SELECT *, max(CASE WHEN change THEN abs END) OVER (PARTITION BY document_id "
    "ORDER BY abs ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, coalesce(lag(path) OVER (PARTITION BY "
    "document_id ORDER BY abs) <> path, TRUE) AS change FROM tree_seg))",
    "tree_seg",
)
grouped_tree("sec", "tree_sec", SECTIONS, "document_id, section", "g.section")


@query(
    "chunk_hierarchy",
    with_pieces("sec_chunks") + "SELECT document_id, start, chunk_id, content, token_count, path FROM sec_chunks",
)
def chunk_hierarchy(t):
    return C.chunk(B.tree_elements(t), SECTIONS).select(
        "document_id", "start", "chunk_id", "content", "token_count",
        F.array_join("hierarchy_context", " > ").alias("path"),
    )


piece("tree_flat", "SELECT *, abs AS pos FROM tree_seg", "tree_seg")
B.pack_pieces("kid", "tree_flat", FAMILIES.max_tokens)
piece(
    "kid_in",
    "SELECT document_id, s, stop, content, ids, tokens, path, row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS pos "
    "FROM (SELECT g.document_id, g.s, g.stop, string_agg(e.text, chr(10) ORDER BY e.pos) AS content, "
    "string_agg(e.id, ',' ORDER BY e.pos) AS ids, sum(e.tokens) AS tokens, arg_min(e.path, e.pos) AS path FROM kid_groups g JOIN tree_flat e ON "
    "e.document_id = g.document_id AND e.pos >= g.s AND e.pos < g.stop GROUP BY ALL)",
    "kid_groups", "tree_flat",
)


def family_pieces(tag: str, config: C.ChunkConfig) -> None:
    B.pack_pieces(f"{tag}p", "kid_in", config.max_tokens, 0, "document_id", config.max_children)
    piece(
        f"{tag}_parents",
        "SELECT *, " + B.sql_id("chk", "document_id", f"'{config.identity}'", "ids", "''", "content")
        + " AS chunk_id FROM (SELECT g.document_id, g.s AS k0, g.stop AS k1, min(k.s) AS start, "
        "string_agg(k.content, chr(10) ORDER BY k.pos) AS content, string_agg(k.ids, ',' ORDER BY k.pos) AS ids, "
        f"sum(k.tokens) AS token_count, arg_min(k.path, k.pos) AS path FROM {tag}p_groups g JOIN kid_in k ON k.document_id = g.document_id AND "
        "k.pos >= g.s AND k.pos < g.stop GROUP BY ALL)",
        f"{tag}p_groups", "kid_in",
    )
    piece(
        f"{tag}_kids",
        "SELECT k.document_id, k.s AS start, k.content, k.tokens AS token_count, p.chunk_id AS parent_chunk_id, k.pos, k.path, "
        + B.sql_id("chk", "k.document_id", f"'{config.identity}'", "k.ids", "p.chunk_id", "k.content")
        + f" AS chunk_id FROM kid_in k JOIN {tag}_parents p ON p.document_id = k.document_id AND k.pos >= p.k0 AND "
        "k.pos < p.k1",
        f"{tag}_parents", "kid_in",
    )
    piece(
        f"{tag}_chunks",
        f"SELECT p.document_id, p.start, p.chunk_id, p.content, p.token_count, p.path, '' AS parent_chunk_id, "
        f"string_agg(k.chunk_id, ',' ORDER BY k.pos) AS children FROM {tag}_parents p JOIN {tag}_kids k ON "
        "k.parent_chunk_id = p.chunk_id GROUP BY ALL UNION ALL SELECT document_id, start, chunk_id, content, token_count, path, "
        f"parent_chunk_id, '' FROM {tag}_kids",
        f"{tag}_parents", f"{tag}_kids",
    )


# Children of at most 20 words in parents of at most 20 words: families of one; the wider limit
# below packs the same children further.
family_pieces("fam", FAMILIES)


@query(
    "chunk_parent_child",
    with_pieces("fam_chunks")
    + "SELECT document_id, start, chunk_id, content, token_count, parent_chunk_id, children FROM fam_chunks",
)
def chunk_parent_child(t):
    return C.chunk(B.tree_elements(t), FAMILIES).select(
        "document_id", "start", "chunk_id", "content", "token_count",
        F.coalesce("parent_chunk_id", F.lit("")).alias("parent_chunk_id"),
        F.array_join("child_chunk_ids", ",").alias("children"),
    )


# ---------------------------------------------------------------- tables

piece(
    "sheet_lines",
    "SELECT ck, r, string_agg('c' || c || '[1x1]=' || text, ' | ' ORDER BY c) AS line FROM sheet_cells_in GROUP BY ALL",
    "sheet_cells_in",
)
piece(
    "sheet_head",
    "SELECT c_custkey AS ck, 'Table: ' || c_name || chr(10) || 'Headers: order | status | priority' AS prefix FROM customer "
    "WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
piece(
    "sheet_rows_in",
    f"SELECT ck, r, line, len({B.sql_words('line')}) AS tokens, len({B.sql_words('prefix')}) AS head, prefix FROM sheet_lines "
    "JOIN sheet_head USING (ck)",
    "sheet_lines", "sheet_head",
)
piece(
    "sheet_walk",
    "SELECT ck, -1 AS r, 0 AS part, head AS used, head FROM (SELECT DISTINCT ck, head FROM sheet_rows_in) UNION ALL "
    f"SELECT w.ck, n.r, CASE WHEN w.used + n.tokens > {SHEETS.max_tokens} THEN w.part + 1 ELSE w.part END, "
    f"CASE WHEN w.used + n.tokens > {SHEETS.max_tokens} THEN n.head + n.tokens ELSE w.used + n.tokens END, n.head "
    "FROM sheet_walk w JOIN sheet_rows_in n ON n.ck = w.ck AND n.r = w.r + 1",
    "sheet_rows_in",
)
piece(
    "sheet_parts",
    "SELECT w.ck, w.part, any_value(n.prefix) || chr(10) || string_agg(n.line, chr(10) ORDER BY n.r) AS content "
    "FROM sheet_walk w JOIN sheet_rows_in n ON n.ck = w.ck AND n.r = w.r GROUP BY ALL",
    "sheet_walk", "sheet_rows_in",
)


@query("render_tables", with_pieces("sheet_parts") + "SELECT 'tbl-' || ck AS table_id, part, content FROM sheet_parts")
def render_tables(t):
    made = C.render_tables(B.sheet_tables(t), B.sheet_cells(t), B.sheet_elements(t), SHEETS.max_tokens)
    return made.select("table_id", "part", "content")


def sheet_chunks(t):
    return C.chunk(B.sheet_elements(t), SHEETS, B.sheet_tables(t), B.sheet_cells(t))


piece(
    "sheet_chunks_in",
    "SELECT 'sheet-' || ck AS document_id, start, content, ids, " + B.sql_id(
        "chk", "'sheet-' || ck", f"'{SHEETS.identity}'", "ids", "''", "content"
    ) + f" AS chunk_id, len({B.sql_words('content')}) AS token_count FROM ("
    "SELECT ck, 0 AS start, (SELECT c_name FROM customer WHERE c_custkey = ck) AS content, 'c-' || ck AS ids FROM sheet_head "
    "UNION ALL SELECT ck, 1 + part, content, concat_ws(',', 'c-' || ck, 't-' || ck, 'n-' || ck) FROM sheet_parts UNION ALL "
    "SELECT ck, 2 + (SELECT max(part) FROM sheet_parts p WHERE p.ck = h.ck), 'note ' || (SELECT c_mktsegment FROM customer "
    "WHERE c_custkey = h.ck), 'n-' || ck FROM sheet_head h)",
    "sheet_head", "sheet_parts",
)


@query(
    "chunk_table",
    with_pieces("sheet_chunks_in")
    + "SELECT document_id, start, content, ids, chunk_id, token_count FROM sheet_chunks_in",
)
def chunk_table(t):
    return sheet_chunks(t).select(
        "document_id", "start", "content", F.array_join("source_element_ids", ",").alias("ids"), "chunk_id", "token_count"
    )


@query(
    "chunk_metrics",
    with_pieces("sheet_chunks_in")
    + "SELECT document_id, count(*) AS chunks, sum(token_count)::BIGINT AS total_tokens, 0 AS parent_links, count(*) AS "
    "table_groups FROM sheet_chunks_in GROUP BY document_id",
)
def chunk_metrics(t):
    return C.chunk_metrics(sheet_chunks(t), "table")


@query(
    "enrich",
    with_pieces("fx_chunks")
    + "SELECT chunk_id, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS document_class, 'alpha' AS team, 'string' AS value_type, "
    "'enricher@1' AS producer, '[\"a\", \"b\"]' AS tags, 'list' AS tags_type, chunk_id AS made_for FROM fx_chunks",
)
def enrich(t):
    made = C.enrich(B.lexical_docs(t), {"team": "alpha", "tags": ["a", "b"]}, "enricher@1", "c2")
    return made.select(
        "chunk_id", F.col("enrichments.document_class.value").alias("document_class"),
        F.col("enrichments.team.value").alias("team"), F.col("enrichments.team.value_type").alias("value_type"),
        F.col("enrichments.team.producer").alias("producer"), F.col("enrichments.tags.value").alias("tags"),
        F.col("enrichments.tags.value_type").alias("tags_type"), F.col("enrichments.tags.source_chunk_id").alias("made_for"),
    )


@query(
    "enrich_rejects",
    with_pieces("fx_chunks") + "SELECT chunk_id AS id, 'enrichment_exists' AS rule FROM fx_chunks",
)
def enrich_rejects(t):
    docs = B.lexical_docs(t).withColumnRenamed("keyword_text", "content").withColumn(
        "source_element_ids", F.transform("citations", lambda c: c["element_id"])
    )
    return C.enrich_rejects(docs, ["document_class"], B.CHUNKS).select("id", "rule")

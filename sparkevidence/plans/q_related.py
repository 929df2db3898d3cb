"""Registered queries: hierarchy and table retrieval, candidate projection, checks of own output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import extend as U
from ..operators import indexing as I
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators import rules
from ..functions.vectors import DIMENSION
from ..schemas import ENRICHMENT
from . import bindings as B
from . import q_chunks as Q
from . import q_evidence as X
from . import q_metrics as M
from .q_retrieval import bm25_pieces
from .registry import piece, query, with_pieces


def tree_docs(t):
    return B.staged(t, "tree_docs", _tree_docs)


def _as_docs(chunks, index):
    no_enrichments = F.from_json(F.lit("{}"), f"map<string,{ENRICHMENT}>")
    return chunks.select(
        F.lit(index).alias("index_id"), "chunk_id", "document_id", F.col("content").alias("keyword_text"), "language",
        "hierarchy_context", "citations", "parent_chunk_id", "child_chunk_ids",
        F.create_map(F.lit("kind"), F.lit("tree")).alias("metadata"),
        no_enrichments.alias("enrichments"),
    )



def _tree_docs(t):
    return _as_docs(C.chunk(B.tree_elements(t), Q.FAMILIES), "tree")


def tree_queries(t):
    """One question per (priority, segment) pair."""
    pairs = t.orders.select("o_custkey", "o_orderpriority").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    ).select("o_orderpriority", "c_mktsegment").distinct()
    text = F.concat_ws(" ", "o_orderpriority", "c_mktsegment")
    return pairs.select(F.concat(F.lit("t-"), text).alias("query_id"), F.lit("tree").alias("index_id"), text.alias("text"))


piece(
    "tree_q",
    "SELECT DISTINCT 't-' || o_orderpriority || ' ' || c_mktsegment AS query_id, o_orderpriority || ' ' || c_mktsegment AS text FROM orders JOIN "
    "customer ON c_custkey = o_custkey",
)
piece("tree_self", "SELECT chunk_id, path || ' ' || content AS txt FROM fam_chunks", "fam_chunks")
piece(
    "tree_parents",
    "SELECT chunk_id, path || ' ' || content AS txt FROM fam_chunks WHERE chunk_id IN (SELECT parent_chunk_id FROM fam_chunks)",
    "fam_chunks",
)
piece(
    "tree_children",
    "SELECT chunk_id, path || ' ' || content AS txt FROM fam_chunks WHERE parent_chunk_id <> ''",
    "fam_chunks",
)
for _mode in ("self", "parents", "children"):
    bm25_pieces(f"h{_mode}", f"tree_{_mode}", "txt", 10, "tree_q")


def _hierarchy_sql(tag: str, relation: str) -> str:
    return (
        with_pieces(f"h{tag}_ranked", "fam_chunks")
        + f"SELECT query_id, chunk_id, rank, round(safe_score, 6) AS safe_score, path, '{relation}' AS relation FROM h{tag}_ranked JOIN fam_chunks "
        "USING (chunk_id)"
    )


def _hierarchy(t, mode):
    docs = tree_docs if B.is_staged(t, "tree_docs") else _tree_docs  # the index alone needs no written documents
    found = R.retrieve_hierarchy(B.indexed(t, "tree_index", docs, R.hierarchy_text()), tree_queries(t), 10, relation_mode=mode)
    return found.select(
        "query_id", "chunk_id", "rank", F.round("safe_score", 6).alias("safe_score"),
        F.array_join("projection.hierarchy_path", " > ").alias("path"),
        F.coalesce("projection.relation", F.lit("")).alias("relation"),
    )


@query("retrieve_hierarchy", _hierarchy_sql("self", ""))
def retrieve_hierarchy(t):
    return _hierarchy(t, "self")


@query("retrieve_hierarchy_parent", _hierarchy_sql("parents", "parent"))
def retrieve_hierarchy_parent(t):
    return _hierarchy(t, "parent")


@query("retrieve_hierarchy_children", _hierarchy_sql("children", "children"))
def retrieve_hierarchy_children(t):
    return _hierarchy(t, "children")


# ---------------------------------------------------------------- tables among other documents


def mixed_docs(t):
    return B.staged(t, "mixed_docs", _mixed_docs)


def _mixed_docs(t):
    sheets = _as_docs(Q.sheet_chunks(t), "tree")
    prose = B.lexical_docs(t).withColumn("index_id", F.lit("tree")).select(*sheets.columns)
    return sheets.unionByName(prose)


bm25_pieces("tab", "sheet_chunks_in", "content", 10, "tree_q")


@query(
    "retrieve_table",
    with_pieces("tab_ranked", "sheet_chunks_in")
    + "SELECT query_id, chunk_id, rank, round(safe_score, 6) AS safe_score, ids AS table_element_ids FROM tab_ranked JOIN sheet_chunks_in USING "
    "(chunk_id)",
)
def retrieve_table(t):
    found = R.retrieve_table(B.indexed(t, "mixed_index", mixed_docs), tree_queries(t), 10)
    return found.select(
        "query_id", "chunk_id", "rank", F.round("safe_score", 6).alias("safe_score"),
        F.array_join("projection.table_element_ids", ",").alias("table_element_ids"),
    )


@query(
    "candidate_projection",
    with_pieces("kw_ranked", "fx_chunks", "elements_in")
    + "SELECT k.query_id, k.chunk_id, " + B.sql_id("cnd", "'corpus'", "'keyword'", "k.chunk_id")
    + " AS candidate_id, count(*) AS n_elements, string_agg(e.page, ',' ORDER BY e.pos) AS pages, 'bm25' AS score_kind FROM kw_ranked k JOIN fx_chunks c "
    "USING (chunk_id) JOIN elements_in e ON e.document_id = c.document_id AND e.pos >= c.start AND e.pos < c.start + c.n_elements GROUP BY ALL",
)
def candidate_projection(t):
    return X.keyword_set(t).select(
        "query_id", "chunk_id", "candidate_id", F.size("element_ids").alias("n_elements"),
        F.array_join(F.transform("locators", lambda x: x["page_number"].cast("string")), ",").alias("pages"), "score_kind",
    )


# ---------------------------------------------------------------- rules on our own output, user parts


@query("own_candidates_pass", "SELECT 'query' AS entity, '' AS id, '' AS rule FROM benchmark WHERE item_id < 0")
def own_candidates_pass(t):
    both = X.keyword_set(t).unionByName(X.vector_set(t))
    return rules.check_candidates(both, B.lexical_docs(t)).select("entity", "id", "rule")


@query("own_chunks_pass", "SELECT 'chunk' AS entity, '' AS id, '' AS rule FROM documents WHERE doc_id < 0")
def own_chunks_pass(t):
    # The rules read the chunks once, so they are not written for this query alone.
    made = tree_docs(t) if B.is_staged(t, "tree_docs") else _tree_docs(t)
    docs = made.withColumnRenamed("keyword_text", "content").withColumn(
        "source_element_ids", F.transform("citations", lambda c: c["element_id"])
    ).withColumn("token_count", F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")))
    return rules.check_chunks(docs).select("entity", "id", "rule")


@query("own_embeddings_pass", "SELECT 'embedding' AS entity, '' AS id, '' AS rule FROM documents WHERE doc_id < 0")
def own_embeddings_pass(t):
    docs = B.search_docs(t).select("chunk_id", "embedding")
    return rules.check_embeddings(docs, DIMENSION, docs).select("entity", "id", "rule")


@query(
    "user_embedder",
    "SELECT doc_id, CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END AS x, CASE WHEN length(text) > 0 THEN 0.0 ELSE 1.0 END AS y FROM documents",
)
def user_embedder(t):
    """A user function on Arrow batches; its output passes the embedding rules in the same job."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    made = U.embed(docs, lambda text: (1.0, 0.0) if text else (0.0, 1.0), 2)
    return made.select(F.col("chunk_id").cast("long").alias("doc_id"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


@query(
    "user_retriever",
    with_pieces("kw_ranked") + "SELECT query_id, chunk_id, rank FROM kw_ranked WHERE rank <= 3",
)
def user_retriever(t):
    mine = lambda docs, asked: R.retrieve_keyword(docs, asked, 3, contributor="mine")
    return U.retrieve(mine, B.lexical_docs(t), B.queries(t)).select("query_id", "chunk_id", "rank")


@query("user_fusion", with_pieces("rrf_ranked") + "SELECT query_id, chunk_id, rank, round(safe_score, 6) AS safe_score FROM rrf_ranked")
def user_fusion(t):
    """A user's fusion of two candidate sets, checked against its inputs."""
    fused = U.fuse(lambda *sets: X.U.rrf(*sets, limit=12), X.keyword_set(t), X.vector_set(t))
    return fused.select("query_id", "chunk_id", "rank", F.round("safe_score", 6).alias("safe_score"))


@query(
    "user_reranker",
    with_pieces("rerank_out")
    + "SELECT query_id, chunk_id, CASE WHEN place <= 8 THEN place END AS output_rank, round(rerank_score, 6) AS rerank_score FROM rerank_out",
)
def user_reranker(t):
    """A user's reranker: a decision for every fused row."""
    mine = lambda fused, asked, docs: X.U.rerank_overlap(fused, asked, docs, limit=8)
    out = U.rerank(mine, X.fused_set(t), B.queries(t), B.lexical_docs(t))
    return out.select("query_id", "chunk_id", "output_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "user_assembler",
    with_pieces("plain_steps", "plain_walk")
    + "SELECT s.query_id, s.n AS source_rank, s.chunk_id FROM plain_steps s JOIN plain_walk w ON w.query_id = s.query_id AND w.n = s.n WHERE w.outcome = s.reason",
)
def user_assembler(t):
    """A user's assembly of evidence: unique chunks, quoted word for word."""
    mine = lambda found, docs: X.V.assemble(found, docs, X.PLAIN)
    out = U.assemble(mine, X.U.reranked(X.rerank_decisions(t)), B.lexical_docs(t))
    return out.filter("selected").select("query_id", "source_rank", "chunk_id")


@query(
    "user_metric",
    with_pieces("kw_ranked", "retrieval_reports")
    + "SELECT case_id, 'metric.user.hit@1' AS metric_id, status, round(coalesce(value, -1), 6) AS value FROM retrieval_reports WHERE metric_id LIKE "
    "'metric.retrieval.hit%'",
)
def user_metric(t):
    registry = U.MetricRegistry()

    def hit(labels, observed):
        rows = K.ranked_metrics(labels, observed, "retrieval", 5, M.gold(t)).filter(F.col("metric_id").startswith("metric.retrieval.hit"))
        return rows.withColumn("metric_id", F.lit("metric.user.hit@1"))

    registry.register("metric.user.hit@1", hit)
    inventory = K.ranked_inventory(X.keyword_set(t), F.col("chunk_id"), "retrieval")
    out = registry.run("metric.user.hit@1", M.cases(t), inventory)
    return out.select("case_id", "metric_id", "status", F.round(F.coalesce("value", F.lit(-1.0)), 6).alias("value"))


@query(
    "embed_queries",
    with_pieces("qv_vec") + "SELECT query_id, b AS bucket, round(v, 6) AS value FROM qv_vec",
)
def embed_queries(t):
    made = I.embed_chunks(B.queries(t).withColumnRenamed("query_id", "chunk_id"), "text")
    return made.select(F.col("chunk_id").alias("query_id"), F.posexplode("embedding").alias("bucket", "v")).filter("v <> 0").select(
        "query_id", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("value")
    )

"""Registered queries: chunks, index and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from . import bindings as B
from .registry import piece, query, with_pieces


@query(
    "chunk_fixed",
    with_pieces("fx_chunks")
    + "SELECT document_id, start, chunk_id, content, n_elements, token_count, language FROM fx_chunks",
)
def chunk_fixed(t):
    return B.chunks(t).select(
        "document_id", "start", "chunk_id", "content", F.size("source_element_ids").alias("n_elements"),
        "token_count", "language",
    )


def bm25_pieces(tag: str, docs: str, text: str, limit: int = 10, queries: str = "queries_in") -> None:
    """Piece `{tag}_ranked(query_id, chunk_id, rank, safe_score)` over every eligible document."""
    piece(f"{tag}_tok", f"SELECT chunk_id, {B.sql_terms(text)} AS ts FROM {docs}", docs)
    piece(f"{tag}_tf", f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term "
                       f"FROM {tag}_tok) GROUP BY ALL", f"{tag}_tok")
    piece(f"{tag}_len", f"SELECT chunk_id, greatest(1, len(ts)) AS dl FROM {tag}_tok", f"{tag}_tok")
    piece(f"{tag}_n", f"SELECT count(*) AS n, avg(dl) AS avgdl FROM {tag}_len", f"{tag}_len")
    piece(f"{tag}_df", f"SELECT term, count(*) AS df FROM {tag}_tf GROUP BY term", f"{tag}_tf")
    piece(f"{tag}_q", f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, "
                      f"unnest({B.sql_terms('text')}) AS term FROM {queries}) GROUP BY ALL", queries)
    piece(
        f"{tag}_score",
        "SELECT q.query_id, f.chunk_id, sum(q.qtf * ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 "
        "/ (f.tf + 1.2 * (0.25 + 0.75 * l.dl / n.avgdl))) AS score "
        f"FROM {tag}_q q JOIN {tag}_tf f USING (term) JOIN {tag}_df d USING (term) "
        f"JOIN {tag}_len l ON l.chunk_id = f.chunk_id CROSS JOIN {tag}_n n GROUP BY ALL",
        f"{tag}_q", f"{tag}_tf", f"{tag}_df", f"{tag}_len", f"{tag}_n",
    )
    rank_pieces(tag, docs, f"{tag}_score", limit, queries)


def rank_pieces(tag: str, docs: str, scores: str, limit: int, queries: str = "queries_in") -> None:
    piece(
        f"{tag}_all",
        "SELECT q.query_id, d.chunk_id, round(greatest(coalesce(s.score, 0), 0), 9) AS raw "
        f"FROM {queries} q CROSS JOIN {docs} d LEFT JOIN {scores} s "
        "ON s.query_id = q.query_id AND s.chunk_id = d.chunk_id",
        docs, scores, queries,
    )
    piece(
        f"{tag}_ranked",
        "SELECT query_id, chunk_id, rank, round(CASE WHEN best > 0 THEN raw / best ELSE 0 END, 9) AS safe_score "
        "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank, "
        f"max(raw) OVER (PARTITION BY query_id) AS best FROM {tag}_all) WHERE rank <= {limit}",
        f"{tag}_all",
    )


bm25_pieces("kw", "fx_chunks", "content")


@query(
    "retrieve_keyword",
    with_pieces("kw_ranked", "fx_chunks")
    + "SELECT query_id, document_id, chunk_id, rank, round(safe_score, 6) AS safe_score "
    "FROM kw_ranked JOIN fx_chunks USING (chunk_id)",
)
def retrieve_keyword(t):
    found = R.retrieve_keyword(B.lexical_index(t), B.queries(t), limit=10)
    return found.select("query_id", "document_id", "chunk_id", "rank", F.round("safe_score", 6).alias("safe_score"))

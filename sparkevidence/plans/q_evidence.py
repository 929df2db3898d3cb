"""Registered queries: fusion, reranking, evidence, answers, decision paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..operators import answers as G
from ..operators import evidence as V
from ..operators import fusion as U
from ..operators import retrieval as R
from . import bindings as B
from . import q_retrieval, q_search  # noqa: F401 - their SQL pieces are used below
from .registry import piece, query, with_pieces


def keyword_set(t):
    return R.retrieve_keyword(B.lexical_index(t), B.queries(t), 10)


def vector_set(t):
    return R.retrieve_vector(B.vector_index(t), B.embedded_queries(t), 10)


def fused_set(t):
    return U.rrf(keyword_set(t), vector_set(t), limit=12)


def rerank_decisions(t):
    return U.rerank_overlap(fused_set(t), B.queries(t), B.lexical_docs(t), limit=8)


piece(
    "sets_in",
    "SELECT 0 AS set_no, 'keyword' AS name, query_id, chunk_id, rank, safe_score FROM kw_ranked UNION ALL "
    "SELECT 1, 'vector', query_id, chunk_id, rank, safe_score FROM vec_ranked",
    "kw_ranked", "vec_ranked",
)
piece(
    "rrf_all",
    "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS total, "
    "string_agg(name || ':' || rank, ',' ORDER BY set_no) AS contributors, "
    "arg_min(safe_score, set_no) AS first_score FROM sets_in GROUP BY ALL",
    "sets_in",
)
piece(
    "rrf_ranked",
    "SELECT query_id, chunk_id, rank, total / best AS safe_score, contributors, first_score FROM (SELECT *, "
    "row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS rank, "
    "max(total) OVER (PARTITION BY query_id) AS best FROM rrf_all) WHERE rank <= 12",
    "rrf_all",
)


@query(
    "rrf",
    with_pieces("rrf_ranked")
    + "SELECT query_id, chunk_id, rank, round(safe_score, 6) AS safe_score, contributors FROM rrf_ranked",
)
def rrf(t):
    return fused_set(t).select(
        "query_id", "chunk_id", "rank", F.round("safe_score", 6).alias("safe_score"),
        F.array_join(
            F.transform("contributions", lambda c: F.concat_ws(":", c["contributor_id"], c["original_rank"])), ","
        ).alias("contributors"),
    )


@query(
    "fusion_metrics",
    with_pieces("rrf_ranked", "sets_in")
    + "SELECT query_id, 2 AS input_sets, count(*) AS input_candidates, count(*) - (SELECT count(*) FROM rrf_ranked r "
    "WHERE r.query_id = s.query_id) AS deduplicated FROM sets_in s GROUP BY query_id",
)
def fusion_metrics(t):
    keyword, vector = keyword_set(t), vector_set(t)
    return U.fusion_metrics(U.rrf(keyword, vector, limit=12), keyword, vector).drop("index_id")


piece(
    "rerank_raw",
    "SELECT r.*, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(q.ts, k.ts))::DOUBLE / len(q.ts) ELSE 0 END AS raw "
    "FROM rrf_ranked r JOIN kw_tok k USING (chunk_id) JOIN (SELECT query_id, list_distinct("
    + B.sql_terms("text") + ") AS ts FROM queries_in) q USING (query_id)",
    "rrf_ranked", "kw_tok", "queries_in",
)
piece(
    "rerank_out",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS place FROM ("
    "SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) "
    "ELSE 0 END AS rerank_score FROM rerank_raw)",
    "rerank_raw",
)


@query(
    "rerank_overlap",
    with_pieces("rerank_out")
    + "SELECT query_id, chunk_id, rank AS input_rank, round(rerank_score, 6) AS rerank_score, "
    "round(safe_score, 6) AS safe_score, CASE WHEN place <= 8 THEN place END AS output_rank, "
    "CASE WHEN place <= 8 THEN 'included' ELSE 'limit_excluded' END AS reason FROM rerank_out",
)
def rerank_overlap(t):
    return rerank_decisions(t).select(
        "query_id", "chunk_id", "input_rank", F.round("rerank_score", 6).alias("rerank_score"),
        F.round("safe_score", 6).alias("safe_score"), "output_rank", "reason",
    )


# ---------------------------------------------------------------- evidence

PLAIN = V.ContextConfig(max_items=4, max_tokens=300, max_excerpt_chars=400, source_diversity="document")
WIDE = V.ContextConfig(
    max_items=6, max_tokens=420, max_excerpt_chars=300, minimum_items=3, structural_rule="hierarchy",
    expand_parent=True, neighbor_window=2,
)
piece(
    "docs_at",
    "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start) - 1 AS ordinal FROM fx_chunks",
    "fx_chunks",
)
piece(
    "rr_in",
    "SELECT r.query_id, r.place AS rank, r.chunk_id, d.document_id, d.content, d.ordinal, r.first_score FROM rerank_out r "
    "JOIN docs_at d USING (chunk_id) WHERE place <= 8",
    "rerank_out", "docs_at",
)


def fold_pieces(tag: str, steps: str, config: V.ContextConfig) -> None:
    """Piece `{tag}_out(query_id, n, outcome)` by stepping through (query_id, n, ...) in order."""
    diverse = "TRUE" if config.source_diversity == "document" else "FALSE"
    piece(
        f"{tag}_walk",
        "SELECT query_id, 0 AS n, 0 AS items, 0 AS used, []::VARCHAR[] AS chs, []::VARCHAR[] AS docs, "
        f"'' AS outcome FROM (SELECT DISTINCT query_id FROM {steps}) UNION ALL "
        "SELECT query_id, n, items + took, used + took * tokens, "
        "CASE WHEN took = 1 THEN list_append(chs, chunk_id) ELSE chs END, "
        "CASE WHEN took = 1 THEN list_append(docs, document_id) ELSE docs END, outcome FROM ("
        "SELECT *, CASE WHEN outcome = reason THEN 1 ELSE 0 END AS took FROM (SELECT w.query_id, s.n, w.items, w.used, "
        "w.chs, w.docs, s.chunk_id, s.document_id, s.tokens, s.reason, CASE WHEN list_contains(w.chs, s.chunk_id) "
        f"THEN 'deduplicated' WHEN {diverse} AND list_contains(w.docs, s.document_id) THEN 'excluded_diversity' "
        f"WHEN w.items >= {config.max_items} OR w.used + s.tokens > {config.max_tokens} THEN 'excluded_budget' "
        f"ELSE s.reason END AS outcome FROM {tag}_walk w JOIN {steps} s ON s.query_id = w.query_id AND s.n = w.n + 1))",
        steps,
    )


piece(
    "plain_steps",
    f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n, chunk_id, document_id, "
    f"'included' AS reason, len({B.sql_words('left(content, 400)')}) AS tokens, first_score FROM rr_in",
    "rr_in",
)
fold_pieces("plain", "plain_steps", PLAIN)
piece(
    "wide_steps",
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank, step, chunk_id) AS n, chunk_id, "
    f"document_id, reason, len({B.sql_words('left(content, 300)')}) AS tokens, first_score FROM ("
    "SELECT query_id, 0 AS phase, rank, 0 AS step, chunk_id, document_id, 'included' AS reason, content, first_score "
    "FROM rr_in UNION ALL SELECT r.query_id, 1, r.rank, o.s, d.chunk_id, d.document_id, 'expanded_neighbor', d.content, "
    "r.first_score FROM rr_in r CROSS JOIN (VALUES (-1, 2), (1, 3), (-2, 4), (2, 5)) o(o, s) JOIN docs_at d ON "
    "d.document_id = r.document_id AND d.ordinal = r.ordinal + o.o)",
    "rr_in", "docs_at",
)
fold_pieces("wide", "wide_steps", WIDE)
_DECIDED = (
    "SELECT s.query_id, s.n AS source_rank, s.chunk_id, w.outcome AS reason, s.tokens, w.outcome = s.reason AS selected, "
    "round(s.first_score, 6) AS safe_score FROM {0}_steps s JOIN {0}_walk w ON w.query_id = s.query_id AND w.n = s.n"
)


def _shown(decisions):
    return decisions.select(
        "query_id", "source_rank", "chunk_id", "reason", "tokens", "selected", F.round("safe_score", 6).alias("safe_score")
    )


def plain_evidence(t):
    return V.assemble(U.reranked(rerank_decisions(t)), B.lexical_docs(t), PLAIN)


def wide_evidence(t):
    return V.assemble(U.reranked(rerank_decisions(t)), B.lexical_docs(t), WIDE)


@query("assemble_evidence", with_pieces("plain_steps", "plain_walk") + _DECIDED.format("plain"))
def assemble_evidence(t):
    return _shown(plain_evidence(t))


@query("expand_evidence", with_pieces("wide_steps", "wide_walk") + _DECIDED.format("wide"))
def expand_evidence(t):
    return _shown(wide_evidence(t))


@query(
    "evidence_shortage",
    with_pieces("wide_steps", "wide_walk", "queries_in")
    + "SELECT query_id, 3 AS minimum_items, coalesce(k, 0) AS selected_items, coalesce(tok, 0) AS selected_tokens, "
    "CASE WHEN n IS NULL THEN 'no_candidates' WHEN k = 0 THEN 'budget_exhausted' WHEN k < 3 THEN 'below_minimum' "
    "WHEN budget THEN 'budget_exhausted' ELSE 'none' END AS shortage FROM queries_in LEFT JOIN ("
    "SELECT query_id, count(*) AS n, count(*) FILTER (selected) AS k, (sum(tokens) FILTER (selected))::BIGINT AS tok, "
    f"bool_or(reason = 'excluded_budget') AS budget FROM ({_DECIDED.format('wide')}) GROUP BY query_id) USING (query_id)",
)
def evidence_shortage(t):
    return V.evidence_shortage(wide_evidence(t), B.queries(t), WIDE).drop("index_id")


piece(
    "fx_cites",
    "SELECT chunk_id, document_id, " + B.sql_id(
        "cit", "document_id", "chunk_id", "ids",
        "places",
    ) + " AS citation_key FROM (SELECT c.chunk_id, c.document_id, string_agg("
    + B.sql_id("elm", "e.document_id", "'paragraph'", "e.pos") + ", ',' ORDER BY e.pos) AS ids, "
    "string_agg('{\"kind\":\"pdf\",\"page_number\":' || e.page || ',\"x0\":0.0,\"x1\":1.0,\"y0\":0.0,\"y1\":1.0}', ',' "
    "ORDER BY e.pos) AS places FROM fx_chunks c JOIN elements_in e ON e.document_id = c.document_id AND "
    "e.pos >= c.start AND e.pos < c.start + c.n_elements GROUP BY c.chunk_id, c.document_id)",
    "fx_chunks", "elements_in",
)


@query(
    "citation_ids",
    with_pieces("fx_cites") + "SELECT chunk_id, citation_key, " + B.sql_id("evd", "citation_key")
    + " AS evidence_id FROM fx_cites",
)
def citation_ids(t):
    docs = B.chunks(t).select(
        "document_id", "chunk_id", F.transform("citations", lambda c: c["element_id"]).alias("element_ids"),
        F.transform("citations", lambda c: c["locator"]).alias("locators"),
    )
    return V.citation_ids(docs).select("chunk_id", "citation_key", "evidence_id")


@query(
    "decision_path",
    with_pieces("kw_ranked", "vec_ranked", "rrf_ranked", "rerank_out", "plain_steps", "plain_walk")
    + ", stages AS (SELECT 0 AS no, 'keyword' AS stage, query_id, chunk_id, rank, 'PRESENT' AS decision FROM kw_ranked "
    "UNION ALL SELECT 1, 'vector', query_id, chunk_id, rank, 'PRESENT' FROM vec_ranked UNION ALL "
    "SELECT 2, 'fusion', query_id, chunk_id, rank, 'PRESENT' FROM rrf_ranked UNION ALL "
    "SELECT 3, 'rerank', query_id, chunk_id, rank, CASE WHEN place <= 8 THEN 'included' ELSE 'limit_excluded' END "
    "FROM rerank_out UNION ALL SELECT 4, 'context', s.query_id, s.chunk_id, s.n, w.outcome FROM plain_steps s JOIN "
    "plain_walk w ON w.query_id = s.query_id AND w.n = s.n), wide AS (SELECT query_id, chunk_id, min(no) AS no, "
    "arg_min(rank, no) AS r, "
    + ", ".join(
        f"coalesce(max(decision) FILTER (stage = '{s}'), 'NOT_PRESENT') AS {s}"
        for s in ("keyword", "vector", "fusion", "rerank", "context")
    )
    + " FROM stages GROUP BY query_id, chunk_id) SELECT query_id, chunk_id, keyword, vector, fusion, rerank, context, "
    "row_number() OVER (PARTITION BY query_id ORDER BY no, r) AS position FROM wide",
)
def decision_path(t):
    present = F.lit("PRESENT").alias("decision")
    ids = ["query_id", "document_id", "chunk_id"]
    keyword, vector = keyword_set(t), vector_set(t)
    fused = U.rrf(keyword, vector, limit=12)
    decided = U.rerank_overlap(fused, B.queries(t), B.lexical_docs(t), limit=8)
    context = V.assemble(U.reranked(decided), B.lexical_docs(t), PLAIN)
    stages = {
        "keyword": keyword.select(*ids, "rank", present),
        "vector": vector.select(*ids, "rank", present),
        "fusion": fused.select(*ids, "rank", present),
        "rerank": decided.select(*ids, F.col("input_rank").alias("rank"), F.col("reason").alias("decision")),
        "context": context.select(*ids, F.col("source_rank").alias("rank"), F.col("reason").alias("decision")),
    }
    return G.decision_path(stages).drop("document_id")


@query(
    "fusion_rejects",
    "SELECT query_id AS id, CASE WHEN n % 3 = 0 THEN 'one_index' ELSE 'distinct_sets' END AS rule FROM (SELECT 'q-' || item_id AS "
    "query_id, item_id AS n FROM benchmark) WHERE n % 3 = 0 OR n % 5 = 0",
)
def fusion_rejects(t):
    """Questions with a second set from another index, or from the contributor of the first."""
    n = F.col("item_id")
    one = t.benchmark.select(F.concat(F.lit("q-"), n).alias("query_id"), F.lit("a").alias("contributor_id"), F.lit("i").alias("index_id"))
    two = t.benchmark.select(
        F.concat(F.lit("q-"), n).alias("query_id"), F.when(n % 5 == 0, "a").otherwise("b").alias("contributor_id"),
        F.when(n % 3 == 0, "j").otherwise("i").alias("index_id"))
    return U.fusion_rejects(one, two).select("id", "rule")


# ---------------------------------------------------------------- answers from conversations

VERIFY = G.VerifyConfig(minimum_items=1, forbidden_phrases=("the the", "DE DE"))


def conv_evidence(t):
    return t.conversations.filter("role <> 'assistant'").select(
        F.concat(F.lit("conv-"), "conv_id").alias("query_id"), "turn",
        stable_id("cit", "conv_id", "turn").alias("citation_key"), F.col("text").alias("excerpt"),
    )


def conv_answers(t):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    replies = t.conversations.filter("role = 'assistant'")
    before = stable_id("cit", F.col("conv_id"), F.col("turn") - 1)
    keys = F.when(F.col("turn") % 4 == 3, F.array(before, F.lit("cit_" + "0" * 32))).otherwise(F.array(before))
    return replies.select(
        F.concat(F.lit("conv-"), "conv_id").alias("query_id"), F.row_number().over(order).alias("attempt"),
        F.col("text").alias("answer"), keys.alias("citation_keys"),
        F.when(F.col("conv_id") % 11 == 0, "ambiguous").when(F.col("conv_id") % 13 == 0, "not_answerable")
        .otherwise("answerable").alias("answerability"),
    )


def conv_queries(t):
    return t.conversations.select(F.concat(F.lit("conv-"), "conv_id").alias("query_id")).distinct()


_TOK = (
    "list_filter(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'), lambda w: w NOT IN "
    "('the','and','for','with','this','that','from','are','was'))"
)
piece(
    "cv_ev",
    "SELECT 'conv-' || conv_id AS query_id, turn, " + B.sql_id("cit", "conv_id", "turn")
    + " AS citation_key, text AS excerpt FROM conversations WHERE role <> 'assistant'",
)
piece(
    "cv_ans",
    "SELECT 'conv-' || conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, "
    "text AS answer, CASE WHEN turn % 4 = 3 THEN [" + B.sql_id("cit", "conv_id", "turn - 1")
    + ", 'cit_' || repeat('0', 32)] ELSE [" + B.sql_id("cit", "conv_id", "turn - 1") + "] END AS citation_keys, "
    "CASE WHEN conv_id % 11 = 0 THEN 'ambiguous' WHEN conv_id % 13 = 0 THEN 'not_answerable' ELSE 'answerable' END "
    "AS answerability FROM conversations WHERE role = 'assistant'",
)
piece(
    "cv_said",
    f"SELECT query_id, attempt, sid, {_TOK.format('sentence')} AS ws FROM (SELECT query_id, attempt, "
    "unnest(regexp_split_to_array(answer, '[.!?]+')) AS sentence, unnest(range(1, len(regexp_split_to_array(answer, "
    "'[.!?]+')) + 1)) AS sid FROM cv_ans)",
    "cv_ans",
)
piece(
    "cv_cited",
    "SELECT a.query_id, a.attempt, count(e.citation_key) AS n_cited, count(DISTINCT k) AS n_keys, "
    "count(DISTINCT k) FILTER (e.citation_key IS NULL) AS n_missing, "
    f"coalesce(flatten(list({_TOK.format('e.excerpt')})), []) AS words FROM (SELECT query_id, attempt, "
    "unnest(citation_keys) AS k FROM cv_ans) a LEFT JOIN cv_ev e ON e.query_id = a.query_id AND e.citation_key = a.k "
    "GROUP BY ALL",
    "cv_ans", "cv_ev",
)
piece(
    "cv_flags",
    "SELECT a.*, c.n_missing > 0 AS f_unknown, contains(lower(answer), 'the the') OR contains(lower(answer), 'de de') "
    "AS f_forbidden, (SELECT count(*) FROM cv_ev e WHERE e.query_id = a.query_id) < 1 AS f_few, "
    "c.n_cited > 0 AND EXISTS (SELECT 1 FROM cv_said s WHERE s.query_id = a.query_id AND s.attempt = a.attempt AND "
    "len(s.ws) > 0 AND NOT list_has_any(s.ws, c.words)) AS f_unsupported FROM cv_ans a JOIN cv_cited c "
    "USING (query_id, attempt)",
    "cv_ans", "cv_cited", "cv_ev", "cv_said",
)
piece(
    "cv_ver",
    "SELECT *, CASE WHEN answerability = 'ambiguous' THEN 'clarification_required' WHEN answerability = "
    "'not_answerable' OR f_few THEN 'abstain' WHEN f_unknown OR f_forbidden OR f_unsupported THEN 'repairable' ELSE "
    "'pass' END AS outcome, concat_ws(',', CASE WHEN f_few THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN f_unknown THEN "
    "'UNKNOWN_CITATION' END, CASE WHEN f_forbidden THEN 'FORBIDDEN_CONTENT' END, CASE WHEN f_unsupported THEN "
    "'UNSUPPORTED_CONTENT' END, CASE answerability WHEN 'ambiguous' THEN 'AMBIGUOUS_QUESTION' WHEN 'not_answerable' "
    "THEN 'NOT_ANSWERABLE' END) AS codes FROM cv_flags",
    "cv_flags",
)


def verified(t):
    return G.verify_answers(conv_answers(t), conv_evidence(t), VERIFY)


@query("verify_answers", with_pieces("cv_ver") + "SELECT query_id, attempt, outcome, codes FROM cv_ver")
def verify_answers(t):
    return verified(t).select("query_id", "attempt", "outcome", F.array_join("failure_codes", ",").alias("codes"))


piece(
    "cv_pick",
    "SELECT v.* FROM cv_ver v JOIN (SELECT query_id, coalesce(min(attempt) FILTER (outcome <> 'repairable'), "
    "max(attempt)) AS attempt FROM cv_ver WHERE attempt <= 3 GROUP BY query_id) USING (query_id, attempt)",
    "cv_ver",
)


@query("select_attempt", with_pieces("cv_pick") + "SELECT query_id, attempt, outcome FROM cv_pick")
def select_attempt(t):
    return G.select_attempt(verified(t), 2).select("query_id", "attempt", "outcome")


piece(
    "cv_final",
    "SELECT q.query_id, p.attempt, CASE outcome WHEN 'pass' THEN 'ANSWERED' WHEN 'clarification_required' THEN "
    "'CLARIFICATION_REQUIRED' WHEN 'abstain' THEN 'ABSTAINED' ELSE 'FAILED' END AS state, CASE WHEN outcome = 'pass' "
    "THEN answer END AS answer, CASE WHEN outcome = 'pass' THEN citation_keys ELSE [] END AS citation_keys, CASE WHEN "
    "outcome = 'pass' THEN NULL WHEN outcome IS NULL THEN 'Retry the configured query after generation is available.' "
    "ELSE 'Provide more evidence or retry the configured query.' END AS action FROM (SELECT DISTINCT 'conv-' || conv_id "
    "AS query_id FROM conversations) q LEFT JOIN cv_pick p USING (query_id)",
    "cv_pick",
)


def final_states(t):
    return G.final_state(conv_queries(t), G.select_attempt(verified(t), 2))


@query(
    "final_state",
    with_pieces("cv_final")
    + "SELECT query_id, attempt, state, answer, array_to_string(citation_keys, ',') AS citation_keys, action FROM cv_final",
)
def final_state(t):
    return final_states(t).withColumn("citation_keys", F.array_join("citation_keys", ","))


@query(
    "answer_visibility",
    with_pieces("cv_final", "cv_ev")
    + "SELECT query_id, state, CASE WHEN state = 'ANSWERED' THEN ok ELSE TRUE END AS available, CASE WHEN state = "
    "'ANSWERED' AND ok THEN answer END AS answer FROM (SELECT *, len(answer) > 0 AND NOT EXISTS (SELECT 1 FROM "
    "(SELECT unnest(f.citation_keys) AS k) u WHERE k NOT IN (SELECT citation_key FROM cv_ev e WHERE e.query_id = "
    "f.query_id)) AS ok FROM cv_final f)",
)
def answer_visibility(t):
    return G.answer_visibility(final_states(t), conv_evidence(t)).drop("citation_keys")

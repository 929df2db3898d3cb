import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkevidence.functions import blocks, postings
from sparkevidence.functions.vectors import hash_embed
from sparkevidence.operators import evidence as V
from sparkevidence.operators import extend as U
from sparkevidence.operators import fusion
from sparkevidence.operators import indexing as I
from sparkevidence.operators import retrieval as R
from sparkevidence.operators import stored

TEXTS = {
    "c1": "red apple pie", "c2": "green apple", "c3": "blue sky over red sea", "c4": "nothing here", "c5": "red red red",
    "c6": "ωμέγα", "c7": "pie pie apple",
}
ENRICH = "map<string,struct<value:string,value_type:string,producer:string,config_digest:string>>"


def make_docs(spark):
    rows = [("i", k, "d" + k[1], v, "en" if i % 2 else "de", i) for i, (k, v) in enumerate(TEXTS.items())]
    made = spark.createDataFrame(rows, "index_id string, chunk_id string, document_id string, keyword_text string, language string, ordinal long")
    place = "named_struct('anchor', cast(null as string), 'kind', if(ordinal = 2, 'spreadsheet', 'pdf'))"
    return made.selectExpr(
        "*", f"array(named_struct('element_id', concat('e', ordinal), 'locator', {place})) citations", "array('Top') hierarchy_context",
        "if(ordinal = 4, 'c1', cast(null as string)) parent_chunk_id", "if(ordinal = 0, array('c5'), cast(array() as array<string>)) child_chunk_ids",
        "map('k', 'v') metadata", f"from_json('{{\"f\":{{\"value\":\"x\"}}}}', '{ENRICH}') enrichments",
    ).withColumn("embedding", hash_embed(F.col("keyword_text")))


def make_queries(spark):
    q = spark.createDataFrame([("q1", "i", "Red apple red"), ("q2", "i", "pie"), ("q3", "i", "zzz")], "query_id string, index_id string, text string")
    return q.withColumn("embedding", hash_embed(F.col("text")))


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return make_queries(spark).cache()


def bm25(query, limit=10, floor=1):
    split = lambda s: re.findall("[a-z0-9]+", s.lower())
    held = {k: Counter(split(v)) for k, v in TEXTS.items()}
    size = {k: max(1, sum(c.values())) for k, c in held.items()}
    mean, n = sum(max(floor, sum(c.values())) for c in held.values()) / len(size), len(size)
    scores = {}
    for k, c in held.items():
        s = 0.0
        for term, count in Counter(split(query)).items():
            df = sum(term in other for other in held.values())
            if c[term]:
                s += count * math.log(1 + (n - df + .5) / (df + .5)) * c[term] * 2.2 / (c[term] + 1.2 * (.25 + .75 * size[k] / mean))
        scores[k] = s
    top = max(scores.values())
    ranked = sorted(scores, key=lambda k: (-round(scores[k], 9), k))[:limit]
    return [(k, round(scores[k] / top, 6) if top else 0.0) for k in ranked]


@pytest.mark.parametrize("limit", [3, 10])
def test_keyword_equals_brute_force(spark, docs, queries, limit, monkeypatch):
    monkeypatch.setattr(blocks, "DOC_ROWS", 2)
    found = R.retrieve_keyword(docs, queries, limit).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        got = [(r.chunk_id, round(r.safe_score, 6)) for r in found if r.query_id == q.query_id]
        assert got == bm25(q.text, limit)


def test_persisted_postings_give_the_same(spark, docs, queries):
    direct = R.retrieve_keyword(docs, queries, 4).select("query_id", "chunk_id", "rank", "safe_score").collect()
    read = R.retrieve_from_postings(stored.as_index(docs), queries, 4).select(*direct[0].__fields__).collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, read))


def test_written_index_reads_back(spark, docs, tmp_path):
    stored.write_index(docs, str(tmp_path / "index"))
    index = stored.read_index(spark, str(tmp_path / "index"))
    flat = index.postings.select("term", "shard", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("x")).select(
        "term", "shard", F.col("x.places").alias("place"), "x.tfs", "x.dls").join(index.documents, ["shard", "place"])
    got = {(r.term, r.chunk_id): r.tfs for r in flat.collect()}
    assert got == {(r.term, r.chunk_id): r.tf for r in I.build_postings(docs).collect()}
    assert all(r.dls == max(1, r.dl) for r in flat.collect()) and "keyword_text" not in index.documents.columns


def _many(spark, n=900):
    """Documents over several shards, with copies, empty texts and two indexes; ids not in the order of reading."""
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(words[(i * 7 + j * j) % (5 + i % 36)] for j in range(i % 23)) if i % 5 else "w1 w2 w3"
        rows.append((f"i{i % 2}", f"c{i * 37 % 1000:04d}", text, "en" if i % 3 else "de"))
    made = spark.createDataFrame(rows, "index_id string, chunk_id string, keyword_text string, language string").repartition(3)
    return made.withColumn("document_id", F.col("chunk_id")).withColumn("metadata", F.create_map(F.lit("k"), F.col("language"))).withColumn(
        "enrichments", F.from_json(F.lit("{}"), ENRICH)).withColumn("embedding", hash_embed(F.col("keyword_text"), 16)), rows


ASKED = [("q1", "w1 w3 w3 w17"), ("q2", "w2"), ("q3", "nothing"), ("q4", "w39 w38 w5 w1"), ("q5", "")]


def _bm25_over(rows, index_id, language, query, df_rows=None, floor=1):
    split = lambda s: re.findall("[a-z0-9]+", s.lower())
    own = {c: Counter(split(t)) for i, c, t, y in rows if i == index_id and (language is None or y == language)}
    every = {c: Counter(split(t)) for i, c, t, y in rows if i == index_id} if df_rows else own
    size = {k: sum(c.values()) for k, c in own.items()}
    mean = sum(max(floor, s) for s in size.values()) / len(size)
    out = {}
    for k, c in own.items():
        total = 0.0
        for term, count in Counter(split(query)).items():
            df = sum(term in other for other in every.values())
            if c[term]:
                total += count * math.log(1 + (len(own) - df + .5) / (df + .5)) * c[term] * 2.2 / (c[term] + 1.2 * (.25 + .75 * max(1, size[k]) / mean))
        out[k] = round(total, 9)
    return out


@pytest.mark.parametrize("language", [None, "de"])
def test_shards_equal_brute_force(spark, monkeypatch, language):
    monkeypatch.setattr(postings, "SHARD", 64)
    monkeypatch.setattr(postings, "BLOCK", 8)
    docs, rows = _many(spark)
    asked = spark.createDataFrame([(q, i, t) for q, t in ASKED for i in ("i0", "i1")], "query_id string, index_id string, text string").withColumn(
        "embedding", hash_embed(F.col("text"), 16))
    index = stored.as_index(docs)
    found = R.retrieve_keyword(index, asked, 7, R.Filters(language=language)).collect()
    hits = I.hybrid_search(index, asked, 7, 0.7, 0.3, language).collect()
    vectors = {(r.index_id, r.chunk_id): r.embedding for r in docs.collect()}
    of_query = {r.query_id: r.embedding for r in asked.collect()}
    for i in ("i0", "i1"):
        for q, text in ASKED:
            scores = _bm25_over(rows, i, language, text)
            want = sorted(scores, key=lambda k: (-scores[k], k))[:7]
            assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"]) if (r.query_id, r.index_id) == (q, i)] == want
            # Hybrid: frequencies over the whole index, the mean of true lengths.
            lex = _bm25_over(rows, i, language, text, True, 0)
            vec = {k: round(sum(a * b for a, b in zip(of_query[q], vectors[i, k])), 9) for k in lex}
            top, peak = max(lex.values()), max(vec.values())
            both = {k: round(.7 * (lex[k] / top if top > 0 else 0) + .3 * (vec[k] / peak if peak > 0 else 0), 9) for k in lex}
            want = sorted(both, key=lambda k: (-both[k], k))[:7]
            own = [r for r in sorted(hits, key=lambda r: r["rank"]) if (r.query_id, r.index_id) == (q, i)]
            assert [r.chunk_id for r in own] == want and all(abs(r.score - both[r.chunk_id]) < 2e-9 for r in own)
            assert all(r.metadata == {"k": r.language} for r in own)


def test_questions_read_no_text(spark, docs, queries):
    index = stored.as_index(docs)
    for plan in (R.retrieve_keyword(index, queries, 3), R.retrieve_table(index, queries, 3), I.hybrid_search(index, queries, 3)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in text.splitlines() if "ReadSchema" in line and "shard" in line]
        assert scans and not any("keyword_text" in line or "_terms" in line for line in scans)
        # Once for the postings that questions ask, the document table only by its own columns.
        assert len({line.split("ReadSchema")[1] for line in scans if "low_dl" in line}) == 1


def test_blocks_below_the_known_best_are_not_scored():
    n = 60
    held = {"term": ["a"], "places": [list(range(n))], "tfs": [[9] * 4 + [1] * (n - 4)], "dls": [[5] * 4 + [500] * (n - 4)]}
    owner = np.zeros(n, int)
    batch = postings._posting_rows(
        pa.array(["i"]), pa.array([0]), pa.array(["a"]), owner, np.arange(n) * 60, np.array(held["tfs"][0]), np.array(held["dls"][0]))
    row = pa.StructArray.from_arrays([batch.column(c) for c in ("term", *postings._LISTS)], names=["term", *postings._LISTS])
    block = {"q_ids": [["q"]], "q_terms": [["a"]], "q_weights": [[1.0]], "q_offsets": [[0, 1]], "index_id": ["i"], "avgdl": [10.0], "q_width": [0], "q_matrix": [b""]}
    table = pa.table(block)
    queries = postings._Queries({k: table[k][0] for k in block})
    for shard in range(3):
        postings.best_lexical(queries, shard, row, 2, 9)
    assert queries.skipped > queries.seen / 3
    found = np.concatenate(queries.found[0])
    assert {(s, p) for s, p in found[found[:, 2] >= queries.floor[0]][:, :2]} >= {(0, 0), (0, 60)}


def test_cells_below_the_known_best_are_not_scored():
    """Clustered vectors: exact results, and most cells of a shard left out."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((40, 16))
    rows = middle[rng.integers(40, size=1500)] + .05 * rng.standard_normal((1500, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    asked = rows[rng.integers(1500, size=9)]
    block = {"q_ids": [[str(i) for i in range(9)]], "q_terms": [[]], "q_weights": [[]], "q_offsets": [[0] * 10], "index_id": ["i"], "avgdl": [1.0],
             "q_width": [16], "q_matrix": [asked.tobytes()]}
    kinds = {"q_terms": pa.list_(pa.string()), "q_weights": pa.list_(pa.float64())}
    table = pa.table({k: pa.array(v, kinds.get(k)) for k, v in block.items()})
    queries = postings._Queries({k: table[k][0] for k in block})
    alive = rng.random(1500) < .8
    order, ends, centres, radii = postings.cells(rows, 20)
    assert sorted(order) == list(range(1500)) and ends[-1] == 1500
    postings.best_vector(queries, 0, order, rows[order], ends, centres, radii, alive[order], 5, 9)
    assert queries.skipped > .6 * queries.seen
    dots = np.where(alive, np.round(asked @ rows.T, 9), -1)
    for q in range(9):
        got = np.concatenate(queries.found[q])
        assert got[np.lexsort((got[:, 1], -got[:, 2])), 1].astype(int).tolist() == np.lexsort((np.arange(1500), -dots[q]))[:5].tolist()


def test_skyband_holds_the_best_of_every_mixture():
    rng = np.random.default_rng(3)
    for n in (5, 80, 3000):
        lex = np.where(rng.random(n) < .7, 0, np.round(rng.random(n) * 9, 1))
        vec = np.round(rng.standard_normal(n) * .3, 2)
        kept = set(postings.skyband(lex, vec, 10, 1e-6).tolist())
        for w in np.linspace(.02, .98, 25):
            total = np.round(w * lex / lex.max() + (1 - w) * vec / vec.max(), 9)
            order = np.lexsort((np.arange(n), -total))[:10]
            assert {int(i) for i in order} <= kept
        assert n < 3000 or len(kept) < n / 4


def test_vector_equals_brute_force_and_clamps(spark, docs, queries):
    vectors = {r.chunk_id: r.embedding for r in docs.collect()}
    found = R.retrieve_vector(docs, queries, 4).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        raw = {k: round(max(0.0, sum(a * b for a, b in zip(q.embedding, v))), 9) for k, v in vectors.items()}
        want = sorted(raw, key=lambda k: (-raw[k], k))[:4]
        assert [r.chunk_id for r in found if r.query_id == q.query_id] == want


def test_chunk_without_terms_still_has_a_vector(docs):
    row = docs.filter("chunk_id = 'c6'").first()
    assert abs(sum(x * x for x in row.embedding) - 1) < 1e-9
    assert I.build_postings(docs).filter("chunk_id = 'c6'").count() == 0


def test_hybrid_equals_brute_force(docs, queries):
    vectors = {r.chunk_id: r.embedding for r in docs.collect()}
    found = I.hybrid_search(docs, queries, 7).orderBy("query_id", "rank").collect()
    q = queries.filter("query_id = 'q1'").first()
    lex = dict(bm25(q.text, floor=0))  # hybrid search divides by the mean of true lengths
    raw = {k: sum(a * b for a, b in zip(q.embedding, v)) for k, v in vectors.items()}
    top = max(raw.values())
    for r in (r for r in found if r.query_id == "q1"):
        assert abs(r.score - (0.5 * lex[r.chunk_id] + 0.5 * raw[r.chunk_id] / top)) < 1e-5


def test_filters(docs, queries):
    assert {r.chunk_id for r in R.eligible(docs, R.Filters(language="de")).collect()} == {"c1", "c3", "c5", "c7"}
    assert R.eligible(docs, R.Filters(metadata={"gone": None, "k": "v"})).count() == 7
    assert R.eligible(docs, R.Filters(enrichments={"gone": "x"})).count() == 0
    assert R.eligible(docs, R.Filters(enrichments={"f": "x"}, document_class="a")).count() == 0
    row = R.retrieve_metadata(docs, queries, 1, R.Filters(language="de", metadata={"k": "v"})).first()
    assert row.projection.matched_filter_keys == ["k", "language"]
    counts = R.filtered_count(docs, queries, R.Filters(language="de"))
    assert {r.filtered_count for r in counts.collect()} == {3}
    empty = R.retrieve_keyword(docs, queries, 3, R.Filters(language="xx"))
    flags = R.retrieval_metrics(empty, R.filtered_count(docs, queries, R.Filters(language="xx"))).collect()
    assert all(r.no_candidates and r.candidates == 0 for r in flags)


def test_relations_and_tables(docs, queries):
    assert {r.chunk_id for r in R.retrieve_hierarchy(docs, queries, 5, relation_mode="parent").collect()} == {"c1"}
    kids = R.retrieve_hierarchy(docs, queries, 5, relation_mode="children").collect()
    assert {r.chunk_id for r in kids} == {"c5"} and kids[0].projection.relation == "children"
    assert {r.chunk_id for r in R.retrieve_table(docs, queries, 5).collect()} == {"c3"}


def test_fusion_rerank_and_evidence(docs, queries):
    keyword, vector = R.retrieve_keyword(docs, queries, 5), R.retrieve_vector(docs, queries, 5)
    fused = fusion.rrf(keyword, vector, limit=4)
    top = fused.filter("query_id = 'q1' and rank = 1").first()
    assert top.safe_score == 1.0 and [c.contributor_id for c in top.contributions] == ["keyword", "vector"]
    assert fusion.fusion_rejects(keyword, vector).count() == 0
    assert {r.rule for r in fusion.fusion_rejects(keyword, keyword).collect()} == {"distinct_sets"}
    decided = fusion.rerank_overlap(fused, queries, docs, 2)
    assert decided.filter("reason = 'included'").count() == 6 and decided.count() == 12
    config = V.ContextConfig(2, 6, 9, 2, "hierarchy", True, 1)
    out = V.assemble(fusion.reranked(decided), docs, config)
    reasons = {r.reason for r in out.collect()}
    assert "included" in reasons and reasons <= {"included", "deduplicated", "excluded_budget", "expanded_parent", "expanded_neighbor"}
    assert all(len(r.excerpt) <= 9 and r.citation_key.startswith("cit_") for r in V.evidence_items(out).collect())
    nobody = V.evidence_shortage(out.filter("false"), queries, config)
    assert {r.shortage for r in nobody.collect()} == {"no_candidates"}


def test_user_parts_are_checked(spark, docs, queries):
    keyword = lambda d, q: R.retrieve_keyword(d, q, 3)
    assert U.retrieve(keyword, docs, queries).count() == 9
    with pytest.raises(U.RejectedOutput):
        U.retrieve(lambda d, q: keyword(d, q).withColumn("rank", F.col("rank") + 1), docs, queries)
    with pytest.raises(U.RejectedOutput):
        U.embed(docs, lambda t: (2.0, 0.0), 2, "keyword_text")
    fused = U.fuse(lambda a, b: fusion.rrf(a, b), keyword(docs, queries), R.retrieve_vector(docs, queries, 3))
    assert U.rerank(lambda f, q, d: fusion.rerank_overlap(f, q, d, 2), fused, queries, docs).count() == fused.count()
    with pytest.raises(U.RejectedOutput):
        U.rerank(lambda f, q, d: fusion.rerank_overlap(f, q, d, 2).filter("reason = 'included'"), fused, queries, docs)
    assert U.assemble(lambda c, d: V.assemble(c, d), fused, docs).count() == fused.count()
    registry = U.MetricRegistry()
    registry.register("m@1", lambda labels, seen: labels.selectExpr("'m@1' metric_id", "'VALUE' status", "1.0 value"))
    assert registry.run("m@1", queries, docs).count() == 3
    with pytest.raises(KeyError):
        registry.run("other@1", queries, docs)


def test_two_indexes_with_the_same_chunks_stay_apart(spark, docs, queries):
    """Every chunk in two indexes, every question on both: each answer stays in its index."""
    both = docs.unionByName(docs.withColumn("index_id", F.lit("other")))
    asked = queries.unionByName(queries.withColumn("index_id", F.lit("other")))
    alone = R.retrieve_keyword(docs, queries, 4).select("query_id", "chunk_id", "rank", "safe_score").collect()
    for index_id in (docs.first().index_id, "other"):
        found = R.retrieve_keyword(both, asked, 4).filter(F.col("index_id") == index_id)
        assert sorted(found.select("query_id", "chunk_id", "rank", "safe_score").collect()) == sorted(alone)
    assert R.retrieve_keyword(both, asked, 4).groupBy("query_id", "candidate_id").count().filter("count > 1").isEmpty()


def test_nine_candidate_sets_fuse(spark, docs, queries):
    sets = [R.retrieve_keyword(docs, queries, 4, contributor=f"k{i}") for i in range(9)]
    fused = fusion.rrf(*sets, limit=4)
    assert all(len(r.contributions) == 9 for r in fused.collect())


def test_two_indexes_stay_two_lists(spark, docs, queries):
    """Chunks in two indexes and questions on both, through retrieval, fusion, reranking and evidence."""
    both = docs.unionByName(docs.filter("chunk_id <> 'c5'").withColumn("index_id", F.lit("j")))
    asked = queries.unionByName(queries.withColumn("index_id", F.lit("j")))
    keyword, vector = R.retrieve_keyword(both, asked, 4), R.retrieve_vector(both, asked, 4)
    fused = fusion.rrf(keyword, vector, limit=4)
    decided = fusion.rerank_overlap(fused, asked, both, 3)
    config = V.ContextConfig(max_items=2, structural_rule="none")
    items = V.assemble(fusion.reranked(decided), both, config)
    shortage = {(r.query_id, r.index_id): r.selected_items for r in V.evidence_shortage(items, asked, config).collect()}
    assert set(shortage) == {(q, i) for q in ("q1", "q2", "q3") for i in "ij"}
    counts = fusion.fusion_metrics(fused, keyword, vector).collect()
    assert len(counts) == 6 and all(r.input_sets == 2 for r in counts)
    for index_id, own, mine in (("i", docs, queries), ("j", both.filter("index_id = 'j'"), asked.filter("index_id = 'j'"))):
        alone = fusion.rrf(R.retrieve_keyword(own, mine, 4), R.retrieve_vector(own, mine, 4), limit=4)
        shape = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.filter(F.col("index_id") == index_id).collect())
        assert shape(fused) == shape(alone)
        single = V.assemble(fusion.reranked(fusion.rerank_overlap(alone, mine, own, 3)), own, config)
        picked = lambda df: sorted((r.query_id, r.source_rank, r.chunk_id, r.reason) for r in df.filter(F.col("index_id") == index_id).collect())
        assert picked(items) == picked(single)

"""Lexical questions read no vectors, vector questions no terms, and vectors are made in small pieces."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkevidence.functions import vectors as V
from sparkevidence.operators import retrieval as R, stored
from sparkevidence.plans import bindings as B
from sparkevidence.plans.catalog import REGISTRY
from sparkevidence.plans.registry import Tables


def by_definition(row, dimension):
    tokens = list(row or []) or ["_"]
    tokens += [a + "\x1f" + b for a, b in zip(tokens, tokens[1:])]
    sums = np.zeros(dimension)
    for token in tokens:
        raw = hashlib.sha256(token.encode()).digest()
        sums[int.from_bytes(raw[:4], "big") % dimension] += 1 if raw[4] & 1 else -1
    return (sums / np.sqrt((sums * sums).sum())).tolist()


def test_vectors_by_slices_follow_their_definition(monkeypatch):
    rng = random.Random(5)
    rows = [None, [], ["a"], *([rng.choice("abcdefgh") + "é" for _ in range(rng.randint(0, 7))] for _ in range(400))]
    for limit in (10, 10**6):
        monkeypatch.setattr(V, "_CACHE_LIMIT", limit)
        known, held = V._Buckets(32), pa.array(rows, pa.list_(pa.string()))
        made = [x for at in range(0, len(rows), 50) for x in V._rows(held.slice(at, 50), known).to_pylist()]
        assert made == [by_definition(r, 32) for r in rows]


def test_each_index_holds_what_its_questions_read(spark, small, tmp_path):
    t = Tables(spark, small)
    docs = B.search_docs(t)
    words = stored.write_index(docs, str(tmp_path / "w"), vectors=False)
    dense = stored.write_index(docs, str(tmp_path / "v"), lexical=False)
    assert words.vectors is None and dense.postings is None and "_terms" not in spark.read.parquet(str(tmp_path / "v/forward")).columns
    both = stored.write_index(docs, str(tmp_path / "b"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(R.retrieve_keyword(words, B.queries(t), 5)) == rows(R.retrieve_keyword(both, B.queries(t), 5))
    assert rows(R.retrieve_vector(dense, B.embedded_queries(t), 5)) == rows(R.retrieve_vector(both, B.embedded_queries(t), 5))


def test_citations_and_keywords_make_no_vectors(spark, small):
    t = Tables(spark, small)
    assert "embedding" not in B.lexical_docs(t).columns
    for name in ("citation_ids", "retrieve_keyword"):
        plan = REGISTRY[name].build(t)._jdf.queryExecution().analyzed().toString()
        assert "embed(" not in plan and "embedding" not in plan, name


def test_documents_are_not_shuffled_to_meet_what_was_found(spark, small):
    t = Tables(spark, small)
    found = R.retrieve_keyword(B.lexical_index(t), B.queries(t), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("SortMergeJoin" in line and "shard" in line and "place" in line), line

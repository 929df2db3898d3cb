"""Nearest vectors over several blocks: later blocks hand on only what reaches the best known scores."""

import numpy as np
import pyarrow as pa

from sparkevidence.functions import blocks as B
from sparkevidence.operators import retrieval as R


def test_best_columns_equal_a_full_sort():
    rng = np.random.default_rng(1)
    for rows, docs, keep, digits in ((20, 300, 5, 1), (7, 3, 3, 0), (5, 1, 1, 9)):
        raw = np.round(np.maximum(rng.normal(size=(rows, docs)), 0), digits)
        want = np.argsort(-raw, axis=1, kind="stable")[:, :keep]
        who, col = B.best_columns(raw, np.full(rows, -np.inf), keep)
        assert (col.reshape(rows, keep) == want).all() and (who.reshape(rows, keep)[:, 0] == np.arange(rows)).all()


def test_later_blocks_hand_on_less_and_lose_nothing(spark):
    rng = np.random.default_rng(2)
    given = np.round(rng.normal(size=(400, 4)), 1)
    rows = [("x", f"v{i:03d}", [float(a) for a in v]) for i, v in enumerate(given)]
    made = spark.createDataFrame(rows, "index_id string, id string, vector array<double>").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        pairs = B.best_of_pairs(B.doc_blocks(made, 20), B.query_blocks(made, 100), 5, 9)
        got = {(r.query_id, r.rank): (r.chunk_id, r.raw) for r in R._best(pairs, 5).collect()}
        handed = pairs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    scores = np.round(np.maximum(given @ given.T, 0), 9) + 0.0
    for q in range(400):
        for k, d in enumerate(np.argsort(-scores[q], kind="stable")[:5], 1):
            assert got[f"v{q:03d}", k] == (f"v{d:03d}", scores[q, d])
    assert len(got) == 2000 and handed < 400 * 5 * 20 / 2


def test_screened_scores_equal_a_full_sort():
    """Ties, scores at and below zero, floors, vectors that single precision cannot hold, and NaN."""
    rng = np.random.default_rng(3)
    for scale, digits, clamp in ((1.0, 9, True), (1.0, 1, True), (1.0, 2, False), (1e-6, 9, True), (1e20, 2, False)):
        given = np.round(rng.normal(size=(90, 6)), 2) * scale
        given[40:60] = given[39]
        given[:8] = -np.abs(given[:8])
        if scale == 1e20:
            given[3, 2] = np.nan
        left, floor = given[10:50], np.where(np.arange(40) % 3 == 0, 0.5 * scale, -np.inf)
        docs = B._Docs({"ids": pa.scalar([f"{i:02d}" for i in range(90)]), "matrix": pa.scalar(given.tobytes()), "width": pa.scalar(6)})
        who, at, raw = B.best_in_block(left, docs, floor, 5, digits, clamp)
        full = np.round(left @ given.T, digits) + 0.0
        full = np.where(np.isnan(full), -np.inf, np.maximum(full, 0.0) if clamp else full)
        for q in range(40):
            want = [c for c in np.argsort(-full[q], kind="stable")[:5] if full[q, c] >= floor[q]]
            assert at[who == q].tolist() == want and np.allclose(np.nan_to_num(raw[who == q], nan=-np.inf), full[q, want], rtol=1e-12)


def test_tiles_of_small_indexes_are_not_copied(spark):
    """One tile for a small index, more for a large one; copies are not broadcast, and batches of wide rows end early."""
    def rows(n, big):
        return spark.createDataFrame([("a", big), ("b", n), ("c", n)], "index_id string, rows long")

    got = {r.index_id: (r.shares, r.groups) for r in B.tiles(rows(3, 100_000), rows(2, 400_000).where("index_id <> 'c'"), 50).collect()}
    assert got["b"] == (1, 1) and "c" not in got and got["a"][0] < got["a"][1] and 90 <= got["a"][0] * got["a"][1] <= 130
    vectors = spark.createDataFrame([("x", f"v{i}", [float(i), 1.0]) for i in range(9)], "index_id string, chunk_id string, embedding array<double>")
    plan = R.nearest(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [index_id" in plan and plan.count("BroadcastHashJoin") == 2  # the two numbers of each index
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20

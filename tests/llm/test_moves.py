"""Near duplicates move little: rows are asked for by bitmaps, and neither sketches nor buckets lose a pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkevidence.llm import common, simhash


def test_rows_are_found_where_they_lie(spark):
    """Numbers on both sides of bitmaps and partitions, asked twice, and none at all; rows do not move."""
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, (1 << 33) - 1, 1 << 33, (1 << 33) + 40_000, 5 << 33]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers], "id long, text string")
    for asked in ([], [0], [7, 7, 32768, 1 << 33], numbers[1::2], numbers):
        ids = spark.createDataFrame([(n,) for n in [*asked, 999]], "id long")
        found = simhash.chosen(rows, ids)
        assert found.columns == ["id", "text"] and sorted(r["id"] for r in found.collect()) == sorted(set(asked))
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 1


def test_sketches_and_buckets_keep_every_near_pair(spark):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(3000)]
    texts = []
    for n in range(30):
        base = rng.choices(words, k=rng.choice((6, 40, 300, 1500)))
        texts += [" ".join(base), " ".join(w if rng.random() > 0.02 else "x" for w in base), " ".join(base[: int(len(base) * 0.85)])]
    sets = [simhash.shingles(t) for t in texts]
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    heads = spark.createDataFrame(
        [(n, len(s), simhash.counts(s).tolist(), simhash.prefix(s, none).tolist()) for n, s in enumerate(sets)],
        "id long, size int, counts array<tinyint>, prefix array<long>")
    common_of = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    near = {(a, b) for a in range(len(sets)) for b in range(a) if common_of(a, b) * 9 >= (len(sets[a]) + len(sets[b])) * 4}
    every = spark.createDataFrame([(a, b) for a in range(len(sets)) for b in range(a)], "a long, b long")
    passed = {(r["a"], r["b"]) for r in simhash.enough(every, heads).collect()}
    assert len(near) > 20 and near <= passed and len(passed) < len(sets) * (len(sets) - 1) / 4
    met = simhash.meetings(heads)
    roots = spark.createDataFrame([], "node long, root long")
    assert near <= {(r["a"], r["b"]) for r in simhash.open_pairs(met, roots).collect()}
    # A bucket of sizes that cannot be near copies is not handed on.
    alone = spark.createDataFrame([(1, 100, [5]), (2, 300, [5]), (3, 310, [5])], "id long, size int, prefix array<long>")
    assert {r["id"] for r in simhash.meetings(alone).select("own.id").collect()} == {2, 3}


def test_shuffle_files_end_with_the_written_table(spark):
    before = spark.conf.get(common.FREED, None)
    made, path = common.stage(spark.range(1000).repartition(3, "id"), "freed")
    assert made.count() == 1000 and spark.conf.get(common.FREED, None) == before
    common.drop_staged(spark, path)

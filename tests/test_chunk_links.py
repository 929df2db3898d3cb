"""Links between chunks are checked in one move: the same rejects as by joins, duplicates and nulls included."""

import random

from sparkevidence.operators import rules


def test_links_move_once_and_match_a_plain_count(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        doc, name = f"d{n % 7}", f"k{rng.randrange(60)}"
        parent = None if rng.random() < 0.5 else f"k{rng.randrange(60)}"
        kids = [None if rng.random() < 0.05 else f"k{rng.randrange(60)}" for _ in range(rng.randrange(3))]
        rows.append((doc if rng.random() < 0.95 else None, None if rng.random() < 0.03 else name, "a b", 2 if n % 9 else 3, parent, kids))
    chunks = spark.createDataFrame(
        [(*r, [], []) for r in rows],
        "document_id string, chunk_id string, content string, token_count int, parent_chunk_id string, child_chunk_ids array<string>, "
        "source_element_ids array<string>, citations array<struct<element_id:string>>")
    down = [(d, c, k) for d, c, *_, kids in rows for k in kids]
    up = [(d, p, c) for d, c, _, _, p, _ in rows if p is not None]
    full = lambda x: None not in x
    ups, downs = {x for x in up if full(x)}, {x for x in down if full(x)}
    want = [(c, "token_count") for _, c, _, size, _, _ in rows if size == 3]
    want += [(x[2], "child_without_parent") for x in down if x not in ups] + [(x[2], "parent_without_child") for x in up if x not in downs]
    below = {(d, c) for d, _, c in up if d is not None and c is not None}
    want += [(p, "cycle") for d, p in {(d, p) for d, p, _ in up} if (d, p) in below]
    found = rules.check_chunks(chunks)
    assert sorted(((r["id"], r["rule"]) for r in found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1

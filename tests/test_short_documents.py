"""Documents within one block move once and are chunked where they lie."""

import random

import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import chunking as C
from sparkevidence.schemas import locator

CONFIGS = [C.ChunkConfig("fixed", 20, 6), C.ChunkConfig("hierarchy", 12), C.ChunkConfig("parent_child", 12, 0, 3)]


def made(spark, lengths):
    rng = random.Random(3)
    rows = []
    for d, n in enumerate(lengths):
        for i in range(n):
            head = rng.random() < 0.2
            rows.append((f"d{d}", f"e{d}-{i}", "heading" if head else "paragraph", i, rng.randint(1, 3) if head else None, " ".join(["w"] * rng.randint(0 if not head else 1, 6))))
    df = spark.createDataFrame(rows, "document_id string, id string, kind string, reading_order int, level int, text string")
    return df.withColumn("locator", locator(kind=F.lit("word_processing"), paragraph_index=F.col("reading_order"))).repartition(5)


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: c.strategy)
def test_short_and_long_documents_give_the_chunks_of_blocks(spark, config):
    elements = made(spark, [1, 5, 30, 64, 65, 200])
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(C._chunk(elements, config, None, None, None, 64))
    assert want and rows(C.chunk(elements, config, block=64)) == want == rows(C.chunk(elements, config))


def test_elements_of_short_documents_move_once(spark):
    plan = C.chunk(made(spark, [5, 30, 64]), CONFIGS[2])._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(document_id") == 1, plan

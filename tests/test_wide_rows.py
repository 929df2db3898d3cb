"""Rows of the stored index hold megabytes: little of it is in memory at a time, and questions are not copied for a broadcast."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkevidence.operators import retrieval as R
from sparkevidence.operators import stored


def documents(spark, n):
    vector = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda k: F.sin(F.col("id") * k))
    return spark.range(n).coalesce(1).select(
        F.lit("x").alias("index_id"), F.format_string("c%06d", "id").alias("chunk_id"), F.lit("d").alias("document_id"),
        F.concat_ws(" ", F.lit("all"), (F.col("id") % 7).cast("string")).alias("keyword_text"), F.lit("en").alias("language"), vector.alias("embedding"))


def test_row_groups_hold_a_few_shards(spark, tmp_path):
    index = stored.write_index(documents(spark, 40_000), str(tmp_path), lexical=False)
    groups = [f.metadata.row_group(g) for f in map(pq.ParquetFile, (tmp_path / "vectors").glob("*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.vectors.count() >= 10
    assert max(g.total_byte_size for g in groups) < 64 << 20


def test_questions_few_and_many_find_the_same(spark, tmp_path, monkeypatch):
    index = stored.write_index(documents(spark, 300), str(tmp_path))
    asked = documents(spark, 9).select(F.col("chunk_id").alias("query_id"), "index_id", F.col("keyword_text").alias("text"), "embedding")
    find = lambda: [
        sorted(map(tuple, stored.vector_best(index, asked, 3, 9).collect())),
        sorted((r.query_id, r.chunk_id, r["rank"]) for r in R.retrieve_keyword(index, asked, 3).collect())]
    plan = stored.vector_best(index, asked, 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "explode" not in plan
    few = find()
    monkeypatch.setattr(stored, "FEW_BLOCKS", 0)
    plan = stored.vector_best(index, asked, 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert find() == few and len(few[0]) == 24 and len(few[1]) == 27
    assert np.isfinite([r[4] for r in few[0]]).all()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20

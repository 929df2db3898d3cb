"""Incremental intake and worker freshness on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import ChunkConfig, text_chunks
from ..sources.intake import intake_rejects

# Fixed value: seconds after which a silent worker is stale.
FRESHNESS_SECONDS = 10


def intake_stream(stream: DataFrame) -> DataFrame:
    """Rows (document_id, name, content, arrived_at) with their content digest; late rows stay."""
    return stream.withColumn("content_digest", F.sha2(F.col("content").cast("binary"), 256))


def chunk_batches(path: str, config: ChunkConfig = ChunkConfig(), element_words: int = 120) -> Callable:
    """A foreachBatch function: chunk the contents of each micro-batch that are new and append them.

    A content is new if no earlier batch has written its digest, however long ago that was. Each batch
    writes its chunks, rejects and digests into folders of its own, digests last, so a repeated batch
    overwrites itself and looks only at the digests of the batches before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        size = F.octet_length(F.col("content").cast("binary"))
        intake_rejects(batch).write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")
        docs = batch.filter(size > 0).groupBy("content_digest").agg(
            F.min_by(F.struct("document_id", "content"), "document_id").alias("first")
        ).select(
            "first.document_id", F.split(F.col("first.content").cast("string"), "\n").alias("pages"),
            F.lit(None).cast("string").alias("language"), "content_digest",
        )
        digests = spark.read.schema("content_digest string, batch long").option("recursiveFileLookup", "false")
        home = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digests")
        if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
            earlier = digests.parquet(f"{path}/digests").filter(F.col("batch") < batch_id)
            docs = docs.join(earlier, "content_digest", "left_anti")
        chunks = text_chunks(docs, config, element_words, keep=("content_digest",))
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        docs.select("content_digest").write.mode("overwrite").parquet(f"{path}/digests/batch={batch_id}")

    return write


def start_intake(stream: DataFrame, path: str, checkpoint: str, **kwargs) -> StreamingQuery:
    return (
        intake_stream(stream).writeStream.foreachBatch(chunk_batches(path, **kwargs))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """Newest heartbeat per worker: batch frames, or streams in update mode."""
    return heartbeats.groupBy("worker_id").agg(F.max("ts").alias("last_seen"))


def stale_workers(heartbeats: DataFrame, now, seconds: int = FRESHNESS_SECONDS) -> DataFrame:
    """Workers with the age of their newest heartbeat in microseconds and whether it is too old."""
    at = now if isinstance(now, Column) else F.lit(now)
    age = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return newest_heartbeats(heartbeats).select(
        "worker_id", "last_seen", age.alias("age_micros"), (age > seconds * 1_000_000).alias("stale")
    )

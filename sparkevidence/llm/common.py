"""Helpers of the corpus operators: staged tables in the shared folder and text blocks inside tasks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: UTF-8 bytes of text that one step inside a task handles together; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch of rows that hold megabytes.
BATCH_BYTES = 16 << 20
#: The white space that separates words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without it (tests) gets a temporary one."""
    return shared_dir(spark).rstrip("/")


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged folder; a session that has ended leaves nothing to do."""
    if spark.sparkContext._jsc is None:
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting that deletes a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, partition_by: str | None = None, wide_rows: bool = False) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    What was shuffled for it is deleted once it is written. Returns the table and its path. Paths still present when the driver ends are deleted then.
    wide_rows: rows hold megabytes, so the writer looks at its memory after every row.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    # Small row groups: a writer holds one in memory.
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20))
    if wide_rows:
        writer = writer.option("parquet.block.size.row.check.min", "1").option("parquet.page.size.row.check.min", "1")
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    atexit.register(drop_staged, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts together hold at most `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, spent = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, spent + limit, side="right")))
        yield batch.slice(start, stop - start)
        spent, start = int(ends[stop - 1]), stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for rows that hold whole texts.

    Batches of at most BATCH_ROWS rows (a lower setting of the session stays) keep the copies small that the
    executor and the Python worker hold, and a worker hands unused memory back after its task: it serves
    the next stages too.
    """
    spark = df.sparkSession
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from one task to the next, as long as tasks ask for it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    _asked.add(key)
    return _held[key]


_asked: set[object] = set()


def release() -> None:
    """At the end of a task: drop what it did not ask for, and give freed memory back where the C library can."""
    if not _asked:
        _held.clear()
    _asked.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_wide_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for rows that hold megabytes: a batch ends once it holds BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return in_arrow(df, run, schema)


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[list[str]], dict[str, np.ndarray | list]], fields: str) -> DataFrame:
    """Columns `keep` of df, then those that fn computes from the whole texts, one row for each row.

    fields: DDL of the computed columns. Only the named columns are read, so other columns never clash.
    """
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    kept = [source.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])
    names = [part.split()[0].strip("`") for part in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                out = fn(texts_of(part, text))
                columns = [part.column(c) for c in keep] + [pa.array(out[n]) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return in_arrow(source, run, schema)

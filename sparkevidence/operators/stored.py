"""The stored index: documents by shard and place, postings with block maxima, and vectors by shard.

Questions read no text: terms come from posting rows, lengths stand beside each posting, filters look at the
document table's own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import postings as P
from ..functions.blocks import query_blocks, wide_batches
from ..functions.text import terms
from ..session import materialize, unique_name

_VECTORS = "index_id string, shard long, places binary, width int, matrix binary, ends binary, centres binary, radii binary"
#: Rows of megabytes: the writer looks at its memory after each, and a reader, which holds a row group, gets a few.
_SMALL_GROUPS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Blocks of questions that are sent whole to every task.
FEW_BLOCKS = 64


@dataclass(frozen=True)
class StoredIndex:
    """documents: one row for each chunk (index_id, shard, place, chunk_id, dl and what was given but text and vector)."""

    documents: DataFrame
    postings: DataFrame | None
    vectors: DataFrame | None
    stats: DataFrame | None


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shards = batch.column("index_id").to_pylist(), batch.column("shard").to_numpy()
        places, flat = batch.column("place").to_numpy(), batch.column("embedding")
        sizes = flat.value_lengths().to_numpy()
        new = [0, *(i for i in range(1, len(ids)) if shards[i] != shards[i - 1] or ids[i] != ids[i - 1] or sizes[i] != sizes[i - 1]), len(ids)]
        out = []
        for a, b in zip(new, new[1:]):
            if b == a:
                continue
            matrix = flat.slice(a, b - a).flatten().to_numpy().reshape(b - a, sizes[a])
            order, ends, centres, radii = P.cells(matrix)
            out.append({
                "index_id": ids[a], "shard": int(shards[a]), "places": places[a:b][order].astype("<i4").tobytes(), "width": int(sizes[a]),
                "matrix": matrix[order].tobytes(), "ends": ends.astype("<i8").tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes()})
        kinds = [(n, pa.string() if n == "index_id" else pa.int64() if n == "shard" else pa.int32() if n == "width" else pa.binary())
                 for n in ("index_id", "shard", "places", "width", "matrix", "ends", "centres", "radii")]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))


def write_index(
    search_docs: DataFrame, path: str, text: Column | None = None, vectors: bool = True, lexical: bool = True,
) -> StoredIndex:
    """Write the index of search documents below path; nothing is shuffled.

    Documents are numbered where they are read, in id order inside a partition: SHARD of them are a shard. The
    numbers are written first, so all parts agree on them. text: what is indexed, keyword_text unless given.
    vectors, lexical: whether the index answers questions of that kind; what it does not is not written.
    """
    spark = search_docs.sparkSession
    body = F.col("keyword_text") if text is None else text
    number = F.col("_number")
    kept = [c for c in search_docs.columns if c not in ("keyword_text", "embedding")]
    has_vectors = vectors and "embedding" in search_docs.columns
    carried = [*kept, *(["embedding"] if has_vectors else [])]
    numbered = search_docs.select(*carried, *([terms(body).alias("_terms")] if lexical else [])).sortWithinPartitions(
        "index_id", "chunk_id").withColumn("_number", F.monotonically_increasing_id())
    numbered.select(
        *carried, F.expr(f"_number div {P.SHARD}").alias("shard"), (number % P.SHARD).cast("int").alias("place"),
        *([F.size("_terms").cast("long").alias("dl"), "_terms"] if lexical else []),
    ).write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    if lexical:
        forward.select("index_id", "shard", "place", F.col("_terms").alias("terms"), "dl").mapInArrow(P.invert, P.POSTINGS).write.mode(
            "overwrite").parquet(f"{path}/postings")
        collection_stats(forward).write.mode("overwrite").parquet(f"{path}/stats")
    if has_vectors:
        forward.where(F.col("embedding").isNotNull()).select("index_id", "shard", "place", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
            _vector_rows, _VECTORS).write.mode("overwrite").options(**_SMALL_GROUPS).parquet(f"{path}/vectors")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    forward = spark.read.parquet(f"{path}/forward")
    vectors = spark.read.parquet(f"{path}/vectors") if "embedding" in forward.columns else None
    postings, stats = (spark.read.parquet(f"{path}/{name}") if "_terms" in forward.columns else None for name in ("postings", "stats"))
    return StoredIndex(forward.drop("_terms", "embedding"), postings, vectors, stats)


def as_index(found: DataFrame | StoredIndex, text: Column | None = None, vectors: bool = True, lexical: bool = True) -> StoredIndex:
    """An index as it is; search documents are indexed in the shared folder first."""
    if isinstance(found, StoredIndex):
        return found
    return write_index(found, unique_name(found.sparkSession, "index"), text, vectors, lexical)


def collection_stats(documents: DataFrame) -> DataFrame:
    """Per index: documents, mean length with at least one word each, mean of the true lengths."""
    return documents.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.lit(1), "dl")).alias("avgdl"), F.avg("dl").alias("true_avgdl"))


def salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def masks(documents: DataFrame) -> DataFrame:
    """The places of some documents as one bit mask for each shard."""
    return documents.groupBy("index_id", "shard").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("mask"))


def asked_postings(index: StoredIndex, words: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Posting rows of the terms that words asks for, dealt by shard; only places of `documents` where given.

    Terms asked by all questions are few beside the postings, so Spark broadcasts them while they are small. What is
    found is written, so that the frequencies and the scores do not look it up twice.
    """
    # Written, so that its size is known before the postings would be shuffled to meet it.
    wanted = materialize(words.select("index_id", "term").distinct(), "asked-terms")
    found = index.postings.join(wanted, ["index_id", "term"])
    if documents is not None:
        found = found.join(masks(documents), ["index_id", "shard"]).mapInArrow(P.restrict, P.POSTINGS)
    found = materialize(found, "asked-postings")
    n = salts(found)
    return found.withColumn("salt", F.pmod("shard", F.lit(n)).cast("int")).repartition(n, "index_id", "salt")


def frequencies(asked: DataFrame) -> DataFrame:
    return asked.groupBy("index_id", "term").agg(F.sum("n").alias("df"))


def _beside(rows: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """rows (index_id, salt and others) beside every block of questions of their index.

    A few blocks go to all rows as they are; many are copied, once for each of the n shares of the shards, and both sides
    move. Written first, so that their number is known: Spark takes the copies for as small as the blocks and would broadcast them.
    """
    blocks = materialize(query_blocks(weights), "question-blocks")
    if blocks.count() <= FEW_BLOCKS:
        return rows.join(F.broadcast(blocks), "index_id")
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.join(copies.hint("merge"), ["index_id", "salt"])


def _searched(parts: DataFrame, find) -> DataFrame:
    return wide_batches(parts).mapInArrow(partial(P.search, find), P.FOUND)


def _held(asked: DataFrame) -> DataFrame:
    lists = ("term", "places", "tfs", "dls", "blocks", "top_tf", "low_dl")
    return asked.groupBy("index_id", "salt", "shard").agg(F.collect_list(F.struct(*lists)).alias("held"))


def lexical_best(asked: DataFrame, weights: DataFrame, limit: int, digits: int) -> DataFrame:
    """(index_id, query_id, shard, place, raw): in each task the `limit` best scores above zero of every query."""
    pairs = _beside(_held(asked), weights, salts(asked))
    find = lambda queries, row: P.best_lexical(queries, row["shard"].as_py(), row["held"].values, limit, digits)
    return _searched(pairs, find)


def _vectors(row: dict, queries: P._Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Places, vectors, and which of them the mask lets in (None: all)."""
    places = np.frombuffer(row["places"].as_buffer(), "<i4").astype(np.int64)
    matrix = np.frombuffer(row["matrix"].as_buffer(), "<f8").reshape(len(places), row["width"].as_py())
    if matrix.shape[1] != queries.matrix.shape[1]:
        raise ValueError("vectors of different dimensions in one index")
    if "mask" not in row:
        return places, matrix, None
    return places, matrix, np.unpackbits(np.frombuffer(row["mask"].as_buffer(), np.uint8), bitorder="little")[places] == 1


def vector_best(index: StoredIndex, queries: DataFrame, limit: int, digits: int, documents: DataFrame | None = None) -> DataFrame:
    """(index_id, query_id, shard, place, raw): in each task the `limit` largest dot products above zero of every query.

    Cells of a shard that cannot reach what is known are not scored (see postings.best_vector).
    """
    n = salts(index.vectors)
    own = index.vectors.withColumn("salt", F.pmod("shard", F.lit(n)).cast("int"))
    if documents is not None:
        own = own.join(masks(documents), ["index_id", "shard"])
    asked = queries.select("index_id", F.col("query_id").alias("id"), F.col("embedding").alias("vector"))
    parts = _beside(own, asked, n)

    def find(found: P._Queries, row: dict) -> None:
        places, matrix, alive = _vectors(row, found)
        get = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        ends = get("ends", "<i8")
        P.best_vector(found, row["shard"].as_py(), places, matrix, ends, get("centres", "<f8").reshape(len(ends), -1), get("radii", "<f8"), alive, limit, digits)

    return _searched(parts, find)


def hybrid_best(
    index: StoredIndex, asked: DataFrame, weights: DataFrame, documents: DataFrame | None, keep: int, digits: int, shares: tuple[float, float],
) -> DataFrame:
    """(index_id, query_id, shard, place, lex, vec) of all rows that can be among the `keep` best of both scores."""
    n = salts(asked)
    own = index.vectors.drop("ends", "centres", "radii").withColumn("salt", F.pmod("shard", F.lit(n)).cast("int"))
    if documents is not None:
        own = own.join(masks(documents), ["index_id", "shard"])
    parts = _beside(own.join(_held(asked), ["index_id", "salt", "shard"], "left"), weights, n)

    def find(queries: P._Queries, row: dict) -> None:
        places, matrix, alive = _vectors(row, queries)
        if alive is not None:
            places, matrix = places[alive], matrix[alive]
        held = row["held"].values if row["held"].is_valid else None
        if len(places):
            P.best_hybrid(queries, row["shard"].as_py(), held, places, matrix, keep, digits, shares)

    return _searched(parts, find)

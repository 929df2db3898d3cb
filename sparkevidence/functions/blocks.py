"""Blocks of queries, and exact nearest vectors by scoring document blocks against them inside tasks.

Documents and queries are packed into blocks of two thousand or so rows within their partition (no shuffle).
The blocks of an index are dealt into tiles, a share of the documents beside a group of the queries, and meet by an
equi-join on them: document blocks are repeated for each group, query blocks for each share. How many there are follows
from the pairs of the index, so a large index is scored by many tasks and a small one is not copied. A pair of blocks
yields at most `limit` rows per query; whatever falls behind those can never enter the overall top `limit`, so results
stay exact and no (query, document) pair list is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

DOC_ROWS = 2048
QUERY_ROWS = 256
#: Pairs of a document and a query that are worth a task, and queries that a task meets at most.
TILE_PAIRS = 1 << 24
GROUP_ROWS = 1 << 17
#: Bytes of one Arrow batch of rows that hold megabytes.
WIDE_BYTES = 16 << 20
DOC_BLOCK = "index_id string, block long, ids array<string>, width int, matrix binary"
QUERY_BLOCK = (
    "index_id string, q_block long, q_ids array<string>, q_offsets array<int>, q_terms array<string>, q_weights array<double>, "
    "avgdl double, q_width int, q_matrix binary"
)
SCORED = "index_id string, query_id string, chunk_id string, raw double"


def _ragged(column: pa.ChunkedArray | pa.Array) -> tuple[list[int], pa.Array]:
    """Offsets from 0 and flat values of a list column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tolist(), array.flatten()


def _matrix(column: pa.Array, rows: int) -> tuple[int, bytes]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width, rest = divmod(len(flat), max(rows, 1))
    lengths = pc.list_value_length(column)
    if rest or (rows and pc.min_max(lengths)["min"].as_py() != width):
        raise ValueError("vectors of different dimensions in one index")
    return width, flat.tobytes()


def wide_batches(df: DataFrame) -> DataFrame:
    """df, for Arrow code over rows that hold megabytes: from now on a batch ends once it holds WIDE_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(WIDE_BYTES))
    return df


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[str, int, pa.Table]]:
    """(index, number, rows) of each block: full ones as soon as they are there, the rest of all indexes at most as many as 64 blocks."""
    waiting: dict[str, list[pa.Table]] = {}
    held, made = 0, TaskContext.get().partitionId() << 33

    def cut(index_id: str, least: int) -> Iterator[tuple[str, int, pa.Table]]:
        nonlocal held, made
        part = pa.concat_tables(waiting.pop(index_id))
        while part.num_rows >= least:
            yield index_id, made, part.slice(0, rows).combine_chunks()
            made, held = made + 1, held - min(rows, part.num_rows)
            part = part.slice(rows)
        if part.num_rows:
            waiting[index_id] = [part.combine_chunks()]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for index_id in pc.unique(table["index_id"]).to_pylist():
            part = table.filter(pc.equal(table["index_id"], index_id))
            waiting.setdefault(index_id, []).append(part)
            held += part.num_rows
            if sum(x.num_rows for x in waiting[index_id]) >= rows:
                yield from cut(index_id, rows)
        if held > 64 * rows:
            for index_id in list(waiting):
                yield from cut(index_id, 1)
    for index_id in list(waiting):
        yield from cut(index_id, 1)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def doc_blocks(docs: DataFrame, rows: int = DOC_ROWS) -> DataFrame:
    """Pack (index_id, id, vector) rows into blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index_id, number, part in _pieces(batches, rows):
            width, matrix = _matrix(_column(part, "vector"), part.num_rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "index_id": [index_id],
                    "block": pa.array([number], pa.int64()),
                    "ids": pa.ListArray.from_arrays([0, part.num_rows], _column(part, "id")),
                    "width": pa.array([width], pa.int32()),
                    "matrix": pa.array([matrix], pa.binary()),
                }
            )

    return docs.mapInArrow(pack, DOC_BLOCK)


def query_blocks(queries: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """Pack (index_id, id[, terms, weights, avgdl][, vector]) rows into blocks."""
    lexical, dense = "terms" in queries.columns, "vector" in queries.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index_id, number, part in _pieces(batches, rows):
            offsets, terms = _ragged(part["terms"]) if lexical else ([0], pa.array([], pa.string()))
            weights = _ragged(part["weights"])[1] if lexical else pa.array([], pa.float64())
            width, matrix = _matrix(_column(part, "vector"), part.num_rows) if dense else (0, b"")
            average = pc.max(part["avgdl"]).as_py() if lexical else 1.0
            yield pa.RecordBatch.from_pydict(
                {
                    "index_id": [index_id],
                    "q_block": pa.array([number], pa.int64()),
                    "q_ids": pa.ListArray.from_arrays([0, part.num_rows], _column(part, "id")),
                    "q_offsets": pa.array([offsets], pa.list_(pa.int32())),
                    "q_terms": pa.ListArray.from_arrays([0, len(terms)], terms),
                    "q_weights": pa.ListArray.from_arrays([0, len(weights)], weights),
                    "avgdl": pa.array([average or 1.0], pa.float64()),
                    "q_width": pa.array([width], pa.int32()),
                    "q_matrix": pa.array([matrix], pa.binary()),
                }
            )

    return queries.mapInArrow(pack, QUERY_BLOCK)


def tiles(docs: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """(index_id, shares, groups) from the rows of both sides, (index_id, rows) each: about twice as many tiles as `parts`, or less where there are few pairs.

    Documents are copied for each group and queries for each share; the root makes both copies equal.
    """
    sizes = docs.groupBy("index_id").agg(F.sum("rows").alias("d")).join(queries.groupBy("index_id").agg(F.sum("rows").alias("q")), "index_id")
    sizes = materialize(sizes.withColumn("pairs", F.col("d").cast("double") * F.col("q")), "index-sizes")
    worth = F.greatest(F.col("all") / F.lit(2 * parts), F.lit(float(TILE_PAIRS)))
    counted = sizes.crossJoin(sizes.agg(F.sum("pairs").alias("all"))).withColumn("n", F.ceil(F.col("pairs") / worth))
    shares = F.least("n", F.ceil(F.sqrt(F.col("n") * F.col("d") / F.col("q"))))
    return counted.withColumn("shares", shares).select(
        "index_id", F.col("shares").cast("int").alias("shares"),
        F.greatest(F.ceil(F.col("n") / F.col("shares")), F.ceil(F.col("q") / F.lit(GROUP_ROWS))).cast("int").alias("groups"))


def _meet(doc_side: DataFrame, query_side: DataFrame, dealt: DataFrame | None) -> DataFrame:
    parts = int(doc_side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if dealt is None:
        dealt = tiles(doc_side.select("index_id", F.size("ids").alias("rows")), query_side.select("index_id", F.size("q_ids").alias("rows")), parts)
    own = lambda block, n: F.pmod(F.xxhash64(block), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Tiles are few and their pairs many: more partitions than tiles, so that tasks seldom hold two; a number given here stays as it is.
    count = dealt.agg(F.sum(F.col("shares") * F.col("groups"))).first()[0] or 1
    place = lambda side: side.drop("shares", "groups").repartition(min(3 * parts, 2 * count), "index_id", "share", "group")
    docs = place(doc_side.join(dealt, "index_id").withColumn("share", own("block", "shares")).withColumn("group", every("groups")))
    asked = place(query_side.join(dealt, "index_id").withColumn("group", own("q_block", "groups")).withColumn("share", every("shares")))
    # Spark takes the copies of a side for as small as the side itself and would send them all to the driver to broadcast them.
    return docs.hint("merge").join(asked, ["index_id", "share", "group"]).drop("share", "group")


#: Queries whose best scores a task remembers.
REMEMBERED = 1 << 20
#: Queries that are scored at a time, and pairs that are scored one by one at a time.
_AT_ONCE = 256
_EXACT_PAIRS = 1 << 16


def best_columns(raw: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the `keep` largest scores of each row, ties by column; none below the row's floor.

    A partition finds the last score that counts where the floor is not known yet; only what reaches it is sorted.
    """
    bar = floor
    if np.isneginf(floor).any():
        bar = np.maximum(floor, np.partition(raw, raw.shape[1] - keep, axis=1)[:, raw.shape[1] - keep])
    who, at = np.nonzero(raw >= bar[:, None])
    first = _first(who, at, raw[who, at], keep)
    return who[first], at[first]


def _first(who: np.ndarray, at: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` largest scores of each `who`, ties by `at`, in this order."""
    order = np.lexsort((at, -score, who))
    sorted_who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(sorted_who, sorted_who) < keep]


class _Docs:
    """A document block by ids, with its vectors in single precision."""

    def __init__(self, row: dict) -> None:
        ids = row["ids"].values
        by_id = pc.sort_indices(ids)
        self.ids = ids.take(by_id)
        self.v = np.frombuffer(row["matrix"].as_py()).reshape(len(ids), row["width"].as_py())[by_id.to_numpy()]
        with np.errstate(over="ignore", invalid="ignore"):
            self.low = self.v.astype(np.float32)
            self.size = float(np.sqrt(np.square(self.v).sum(axis=1)).max(initial=0))


def _products(left: np.ndarray, right: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, component after component."""
    out = np.zeros(len(who))
    for i in range(0, len(who), _EXACT_PAIRS):
        a, b = left.T[:, who[i : i + _EXACT_PAIRS]], right.T[:, at[i : i + _EXACT_PAIRS]]
        for x, y in zip(a, b):
            out[i : i + _EXACT_PAIRS] += x * y
    return out


def best_in_block(left: np.ndarray, docs: _Docs, floor: np.ndarray, keep: int, digits: int, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the `keep` largest rounded scores of each query, ties by place; none below the query's floor.

    Products in single precision, which are off by no more than the margin, tell which pairs are scored. Queries whose
    last score may be zero, where clamped scores tie, and vectors beyond single precision are scored as a whole.
    """
    size = np.sqrt(np.square(left).sum(axis=1))
    margin = (left.shape[1] + 8) * 2.0**-24 * 1.1 * size * docs.size + 2 * 10.0**-digits
    fine = bool(len(docs.v)) and docs.size < 1e15 and bool((size < 1e15).all())
    bar, whole = floor, np.arange(len(left))
    who, at, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if fine:
        near = left.astype(np.float32) @ docs.low.T
        if np.isneginf(floor).any():
            bar = np.maximum(floor, np.partition(near, near.shape[1] - keep, axis=1)[:, near.shape[1] - keep] - margin)
        hard = (bar <= margin) if clamp else np.zeros(len(left), bool)
        # Whatever single precision makes of the bar, it stays below.
        need = np.where(hard, np.inf, bar - margin - 1e-6 * np.abs(bar)).astype(np.float32)
        found = np.flatnonzero(near >= need[:, None])
        who, at = np.divmod(found, near.shape[1])
        raw = np.round(_products(left, docs.v, who, at), digits) + 0.0
        enough = raw >= floor[who]
        who, at, raw = who[enough], at[enough], raw[enough]
        first = _first(who, at, raw, keep)
        who, at, raw, whole = who[first], at[first], raw[first], np.flatnonzero(hard)
    if len(whole):
        full = np.round(left[whole] @ docs.v.T, digits) + 0.0
        full = np.maximum(full, 0.0) if clamp else full
        order = np.where(np.isnan(full), -np.inf, full)
        own, col = best_columns(order, floor[whole], keep)
        who, at, raw = np.append(who, whole[own]), np.append(at, col), np.append(raw, full[own, col])
        order = np.argsort(who, kind="stable")
        who, at, raw = who[order], at[order], raw[order]
    return who, at, raw


def best_of_pairs(doc_side: DataFrame, query_side: DataFrame, limit: int, digits: int, clamp: bool = True, dealt: DataFrame | None = None) -> DataFrame:
    """The `limit` largest dot products of each block pair per query, by (score desc, id asc).

    A task remembers the `limit` best scores of each query, so later blocks hand on only what reaches them.
    dealt: tiles of each index; counted from the blocks unless given.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], np.ndarray] = {}
        docs: _Docs | None = None
        last, held = None, 0
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(i)[n] for i, name in enumerate(batch.schema.names)}
                index_id, number = row["index_id"].as_py(), row["block"].as_py()
                if docs is None or last != (index_id, number):
                    last, docs = (index_id, number), _Docs(row)
                q_ids, key = row["q_ids"].values, (index_id, row["q_block"].as_py())
                left = np.frombuffer(row["q_matrix"].as_py()).reshape(len(q_ids), row["q_width"].as_py())
                best = known.pop(key, None)
                if best is None:
                    best = np.full((len(left), limit), -np.inf)
                    held += len(left)
                keep = min(limit, len(docs.ids))
                floor = best.min(axis=1)
                parts = [(a, *best_in_block(left[a : a + _AT_ONCE], docs, floor[a : a + _AT_ONCE], keep, digits, clamp)) for a in range(0, len(left), _AT_ONCE)]
                who = np.concatenate([a + part for a, part, _, _ in parts])
                at, raw = (np.concatenate([part[i] for part in parts]) for i in (2, 3))
                new = np.full((len(left), limit), -np.inf)
                new[who, np.arange(len(who)) - np.searchsorted(who, who)] = np.where(np.isnan(raw), -np.inf, raw)
                known[key] = np.partition(np.hstack([best, new]), limit, axis=1)[:, limit:]
                while held > REMEMBERED and len(known) > 1:
                    held -= len(known.pop(next(iter(known))))
                yield pa.RecordBatch.from_pydict(
                    {
                        "index_id": pa.array([index_id] * len(who), pa.string()),
                        "query_id": q_ids.take(pa.array(who)),
                        "chunk_id": docs.ids.take(pa.array(at)),
                        "raw": pa.array(raw),
                    }
                )

    return wide_batches(_meet(doc_side, query_side, dealt)).mapInArrow(score, SCORED)

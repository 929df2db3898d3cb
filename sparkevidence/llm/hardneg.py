"""Hard-negative mining over integer vectors: rotated one-bit codes filter, integer products decide.

1. A vector of d components is multiplied by a fixed matrix with orthonormal columns (bits x d, from a seed);
   the signs are its code. The code, brought back to d components, is a code vector c; the row keeps its
   alignment <x, c> / <c, c>, the length of the residual x - alignment * c, and 1 / |c|.
2. An anchor's rotated components are rounded to `planes` bits, so <anchor, c> of any row is estimated by
   popcounts of bit planes against the code, with a rounding error that is known for each anchor. The residual
   adds at most (its length) * (length of the anchor's part across c), by Cauchy-Schwarz. So each inner product
   has an interval that surely holds it, and no row is lost by chance.
3. Only rows whose interval reaches the best scores found so far are scored, in whole numbers.
4. Two searches run over the same stored blocks: the best rows of the anchor's label (positives), then for each
   positive the best rows of other labels inside its window (negatives).

Rows are dealt into blocks of at most BLOCK_ROWS, anchors into blocks of about BLOCK_ANCHORS. Every anchor block
goes once to each share of the rows, every row block once to each group of the anchors; a task keeps the best rows of the anchor blocks that it is
at (a few of them) and hands on a few rows for each anchor, which windows rank at the end.

Defined cases: rows with a null label, a null vector or a null, infinite or NaN component take no part; a null id
is never an anchor and comes last among equal scores; rows with the anchor's own id are never its positives; rows
of another dimension are not compared; repeated rows count each for themselves, also as anchors; scores beyond
the range of long are cut to it (products are unbounded whole numbers before); vectors without components
score zero; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, in_wide_arrow, stage

BITS = 512
PLANES = 6
BLOCK_ROWS = 2048
BLOCK_ANCHORS = 256
#: Pairs of an anchor and a row that are worth a task, and rows that are worth a share.
TILE_PAIRS = 1 << 18
SHARE_ROWS = 512
#: Anchor blocks whose best rows a task keeps at a time.
_KEPT = 16
#: Products below this are exact in 64-bit whole numbers, with room for a factor of 100.
_EXACT = 1 << 56
_LONG = np.iinfo(np.int64)


@lru_cache(maxsize=4)
def rotation(d: int, bits: int) -> np.ndarray:
    """bits x d, orthonormal columns, the same in every task up to rounding (which the intervals allow for)."""
    wide = np.random.default_rng(d).standard_normal((max(bits, d), d))
    return np.linalg.qr(wide)[0][:, :d]


def code_bits(d: int, bits: int) -> int:
    """Bits of a code: at least one for each component, in whole 64-bit words."""
    return -(-max(bits, d) // 64) * 64


def encode(x: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Codes of rows (words of 64 bits) with what their intervals need."""
    d = x.shape[1]
    bits = code_bits(d, bits)
    turned = rotation(d, bits)
    signs = x @ turned.T >= 0
    code = np.where(signs, 1.0, -1.0) / np.sqrt(bits)
    c = code @ turned
    inner = np.einsum("ij,ij->i", c, c)
    align = np.einsum("ij,ij->i", x, c) / np.maximum(inner, 1e-300)
    rest = np.linalg.norm(x - align[:, None] * c, axis=1)
    return {
        "codes": np.packbits(signs, axis=1).view("<u8"), "align": align, "rest": rest,
        "inverse": 1 / np.sqrt(np.maximum(inner, 1e-300)), "size": np.linalg.norm(x, axis=1),
    }


class Anchors:
    """Bit planes of a block of anchors."""

    def __init__(self, x: np.ndarray, bits: int, planes: int) -> None:
        d = x.shape[1]
        self.bits = code_bits(d, bits)
        turned = x @ rotation(d, self.bits).T
        top = (1 << planes) - 1
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / top, 1e-300)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        self.error = np.abs(turned - self.low[:, None] - level * self.step[:, None]).sum(axis=1) / np.sqrt(self.bits)
        self.summed = level.sum(axis=1)
        self.planes = [np.packbits(level >> p & 1 == 1, axis=1).view("<u8") for p in range(planes)]
        self.size = np.linalg.norm(x, axis=1)

    def intervals(self, rows: dict[str, np.ndarray], own: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (anchors x rows) between which each inner product surely lies."""
        codes, size, error = rows["codes"], self.size[own, None], self.error[own, None]
        shared = np.zeros((len(size), len(codes)), np.int64)
        for p, plane in enumerate(self.planes):
            count = np.zeros(shared.shape, np.int32)
            for w in range(codes.shape[1]):
                count += np.bitwise_count(plane[own, None, w] & codes[None, :, w])
            shared += count.astype(np.int64) << p
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        # <anchor, c>: components under a one minus the others.
        over = self.low[own, None] * (2 * ones - self.bits) + self.step[own, None] * (2 * shared - self.summed[own, None])
        over /= np.sqrt(self.bits)
        along = np.maximum(np.abs(over) - error, 0) * rows["inverse"]
        reach = rows["rest"] * np.sqrt(np.maximum(np.square(size) - np.square(along), 0))
        reach += np.abs(rows["align"]) * error + 1e-9 * size * rows["size"] + 1e-9
        middle = rows["align"] * over
        return middle - reach, middle + reach


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of whole numbers, unbounded ones where 64 bits may not do."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(*rows)) for rows in zip(a, b)], object)


class Block:
    """A stored block as arrays."""

    def __init__(self, row: dict, prefix: str) -> None:
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.d, self.n = row[prefix + "d"], row[prefix + "n"]
        self.ids, self.nulls, self.labels = get("ids", np.int64), get("nulls", bool), get("labels", np.int64)
        self.v = get("v", np.float64).reshape(self.n, self.d)
        self._coded = {k: get(k, np.float64) for k in ("align", "rest", "inverse", "size")}
        self._coded["codes"] = get("codes", "<u8").reshape(self.n, -1)

    def coded(self, rows: slice) -> dict[str, np.ndarray]:
        return {k: x[rows] for k, x in self._coded.items()}


class Best:
    """The best rows so far of each list: (-score, id is null, id), ascending."""

    def __init__(self, lists: int, keep: int) -> None:
        self.keep = keep
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(lists)]

    def floor(self) -> np.ndarray:
        """Scores that a row must reach to enter each list."""
        return np.array([-float(r[-1][0]) if len(r) == self.keep else -np.inf for r in self.rows])

    def add(self, at: int, r: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype != object and len(rows) > self.keep:
            order = np.lexsort((r.ids[rows], r.nulls[rows], -scores))[: self.keep]
            rows, scores = rows[order], scores[order]
        found = [(-int(s), bool(r.nulls[x]), int(r.ids[x])) for x, s in zip(rows, scores)]
        self.rows[at] = sorted(self.rows[at] + found)[: self.keep]


def _sure(low: np.ndarray, may: np.ndarray, keep: int) -> np.ndarray:
    """Per anchor the score that `keep` rows surely reach."""
    if low.shape[1] < keep:
        return np.full(len(low), -np.inf)
    return -np.partition(-np.where(may, low, -np.inf), keep - 1, axis=1)[:, keep - 1]


def _score(keep: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked pairs, anchor by anchor, and their exact scores."""
    at, to = np.nonzero(keep)
    step = 1 << 16
    scored = [products(anchors[at[i : i + step]], rows[to[i : i + step]]) for i in range(0, len(at), step)]
    return at, to, np.concatenate(scored) if scored else np.zeros(0, np.int64)


def _steps(start: int, end: int, anchors: int) -> Iterator[slice]:
    """Rows in steps whose intervals stay small in memory."""
    step = max(64, (1 << 18) // max(1, anchors))
    return (slice(i, min(end, i + step)) for i in range(start, end, step))


def find_positives(a: Block, coded: Anchors, r: Block, best: Best) -> None:
    """Rows of each anchor's own label; labels lie together in both blocks."""
    for label in np.intersect1d(a.labels, r.labels):
        mine = slice(*(int(i) for i in np.searchsorted(a.labels, [label, label + 1])))
        bounds = np.searchsorted(r.labels, [label, label + 1])
        for own in _steps(int(bounds[0]), int(bounds[1]), mine.stop - mine.start):
            low, high = coded.intervals(r.coded(own), mine)
            may = (a.ids[mine, None] != r.ids[None, own]) | r.nulls[None, own]
            floor = np.maximum(best.floor()[mine], _sure(low, may, best.keep))
            at, to, scores = _score(may & ~(high < floor[:, None]), a.v[mine], r.v[own])
            for i in np.unique(at):
                best.add(mine.start + int(i), r, own.start + to[at == i], scores[at == i])


def find_negatives(a: Block, coded: Anchors, r: Block, best: Best, low_percent: int, high_percent: int, scores_of: list[list[int]]) -> None:
    """Rows of other labels inside the window of each positive; list anchor * positives + positive."""
    lists = len(best.rows) // max(1, a.n)
    scale = np.array([own + [0] * (lists - len(own)) for own in scores_of], float).reshape(a.n, lists)
    there = np.array([[p < len(own) for p in range(lists)] for own in scores_of], bool).reshape(a.n, lists)
    slack = 1e-9 * np.abs(scale)
    least = np.where(there, low_percent * scale / 100 - slack, np.inf)
    most = np.where(there, high_percent * scale / 100 + slack, -np.inf)
    for own in _steps(0, r.n, a.n):
        low, high = coded.intervals(r.coded(own))
        other = a.labels[:, None] != r.labels[None, own]
        floor = best.floor().reshape(a.n, lists)
        keep = np.zeros(other.shape, bool)
        for p in range(lists):
            need = np.maximum(floor[:, p], least[:, p])
            if np.isinf(floor[:, p]).any():
                inside = other & (low >= (least[:, p] + 2 * slack[:, p])[:, None]) & (high <= (most[:, p] - 2 * slack[:, p])[:, None])
                need = np.maximum(need, _sure(low, inside, best.keep))
            keep |= ~(high < need[:, None]) & ~(low > most[:, p, None])
        at, to, scores = _score(keep & other, a.v, r.v[own])
        edges = np.searchsorted(at, np.arange(a.n + 1))
        for i in np.flatnonzero(np.diff(edges)):
            rows, values = own.start + to[edges[i] : edges[i + 1]], scores[edges[i] : edges[i + 1]]
            for p, s in enumerate(scores_of[i]):
                if max(abs(s), 1) * 100 >= _EXACT:
                    values = values.astype(object)
                fits = (100 * values >= low_percent * s) & (100 * values <= high_percent * s)
                if fits.any():
                    best.add(int(i) * lists + p, r, rows[fits], values[fits])


def vector_blocks(rows: DataFrame, parts: int, most: int, bits: int) -> DataFrame:
    """rows (id, label, v) as blocks of one dimension, labels together, with their codes."""
    names = ["block", "d", "low", "high", "n", "ids", "nulls", "labels", "v", "codes", "align", "rest", "inverse", "size"]
    layout = pa.schema([(n, pa.int64() if i < 5 else pa.binary()) for i, n in enumerate(names)])

    def block(number: int, d: int, ids: np.ndarray, nulls: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(labels, kind="stable")
        v = v[order]
        raw = {"ids": ids[order], "nulls": nulls[order], "labels": labels[order], "v": v, **encode(v, bits)}
        head = {"block": TaskContext.get().partitionId() << 24 | number, "d": d, "low": labels.min(), "high": labels.max(), "n": len(ids)}
        return pa.RecordBatch.from_pylist([head | {k: np.ascontiguousarray(x).tobytes() for k, x in raw.items()}], schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            ids, v = batch.column("id"), batch.column("v")
            edges, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            columns = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("label").to_numpy()
            sizes = np.diff(edges)
            for d in map(int, np.unique(sizes)):
                own = np.flatnonzero(sizes == d)
                new = [*(c[own] for c in columns), flat[edges[own][:, None] + np.arange(d)]]
                waiting[d] = [np.concatenate(x) for x in zip(waiting[d], new)] if d in waiting else new
                while len(waiting[d][0]) >= most:
                    yield block(made, d, *(x[:most] for x in waiting[d]))
                    waiting[d] = [x[most:] for x in waiting[d]]
                    made += 1
            while len(waiting) > _KEPT:  # many dimensions: small blocks
                d = next(iter(waiting))
                own = waiting.pop(d)
                if len(own[0]):
                    yield block(made, d, *own)
                    made += 1
        for d, own in waiting.items():
            if len(own[0]):
                yield block(made, d, *own)
                made += 1

    return in_arrow(rows.repartition(parts), run, ", ".join(f"{n} {'long' if i < 5 else 'binary'}" for i, n in enumerate(names)))


def tiles(rows: int, asked: int, most: int) -> tuple[int, int]:
    """(shares of the rows, groups of the anchors) that tasks compare: at most about `most` of them, fewer where there is little to compare.

    Rows are copied for each group, anchors for each share; with shares : groups as rows : anchors both copies are of equal size.
    """
    count = max(1, min(most, rows * asked // TILE_PAIRS))
    shares = min(count, math.ceil(math.sqrt(count * rows / max(1, asked))), -(-rows // SHARE_ROWS))
    return max(1, shares), -(-count // max(1, shares))


def _pairs(anchors: DataFrame, rows: DataFrame, shares: int, groups: int) -> DataFrame:
    """Every anchor block beside every row block of its dimension: anchors go to all shares of the rows, rows to all groups of the anchors."""
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], dealt(groups).alias("group"), every(shares).alias("share"))
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns], dealt(shares).alias("r_share"), every(groups).alias("r_group"))
    met = (F.col("share") == F.col("r_share")) & (F.col("group") == F.col("r_group")) & (F.col("a_d") == F.col("r_d"))
    # Spark takes the copies of a side for as small as the side itself and would send them all to the driver to broadcast them.
    return left.hint("merge").join(right, met).drop("share", "group", "r_share", "r_group")


def _search(pairs: DataFrame, find: Callable, lists: int, keep: int, bits: int, planes: int) -> DataFrame:
    """The best rows of each list of each anchor in each task: block, at (the anchor's place), list, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[Block, Anchors, Best]] = {}
        last: tuple[int, Block] | None = None

        def emit(number: int) -> pa.RecordBatch:
            a, _, best = kept.pop(number)
            out = [
                (number, i // lists, i % lists, None if null else own, max(_LONG.min, min(_LONG.max, -minus)), None if a.nulls[i // lists] else int(a.ids[i // lists]))
                for i, rows in enumerate(best.rows) for minus, null, own in rows]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["block", "at", "list", "id", "score", "anchor_id"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                number = row["a_block"]
                if number not in kept:
                    if len(kept) >= _KEPT:
                        yield emit(next(iter(kept)))
                    a = Block(row, "a_")
                    kept[number] = a, Anchors(a.v, bits, planes), Best(a.n * lists, keep)
                if last is None or last[0] != row["r_block"]:
                    last = row["r_block"], Block(row, "r_")
                a, coded, best = kept[number]
                find(a, coded, last[1], best, row)
        for number in list(kept):
            yield emit(number)

    return in_wide_arrow(pairs, run, "block long, at int, list int, id long, score long, anchor_id long")


def _top(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of each list over all tasks, with their rank."""
    order = Window.partitionBy("block", "at", "list").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    bits: int = BITS, planes: int = PLANES, salts: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id long, label long, v array<double> of whole numbers. anchor: a condition on id. An anchor's positives
    are its first `positives` rows of its label; a negative has low * positive <= 100 * negative <= high * positive.
    """
    most = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = whole.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~broken)
    asked = whole.where(anchor)
    given, wanted = rows.count(), asked.count()
    shares, groups = tiles(given, wanted, most)
    blocks, _ = stage(vector_blocks(whole, max(shares, min(most, -(-given // BLOCK_ROWS))), BLOCK_ROWS, bits), "vectors", wide_rows=True)
    anchors, _ = stage(vector_blocks(asked, max(1, -(-wanted // BLOCK_ANCHORS)), BLOCK_ANCHORS, bits), "anchors", wide_rows=True)

    overlap = (F.col("a_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("a_high"))
    same = _search(_pairs(anchors, blocks, shares, groups).where(overlap), lambda a, c, r, best, row: find_positives(a, c, r, best), 1, positives, bits, planes)
    chosen, _ = stage(_top(stage(same, "same-label")[0], positives), "positives")

    # The scores of its anchors' positives go with a block.
    listed = chosen.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "rank", "score"))).alias("positives"))
    armed = anchors.join(listed, "block")

    def negatives_of(a: Block, coded: Anchors, r: Block, best: Best, row: dict) -> None:
        scores: list[list[int]] = [[] for _ in range(a.n)]
        for p in row["a_positives"]:
            scores[p["at"]].append(p["score"])
        find_negatives(a, coded, r, best, low, high, scores)

    one_label = (F.col("a_low") == F.col("a_high")) & (F.col("a_low") == F.col("r_low")) & (F.col("a_low") == F.col("r_high"))
    other = _search(_pairs(armed, blocks, shares, groups).where(~one_label), negatives_of, positives, negatives, bits, planes)
    top = _top(stage(other, "other-labels")[0], negatives)
    best = chosen.select("block", "at", (F.col("rank") - 1).alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return top.join(best, ["block", "at", "list"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

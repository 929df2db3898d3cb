"""Kernels of the stored index: inversion of a shard, and top rows of a shard for a block of queries.

A shard is a run of SHARD documents of one partition, in id order; a document is its place there. A posting row
holds one term of one shard: places, frequencies, document lengths, and for every BLOCK places that the term
touches the highest frequency and the smallest length, from which the highest gain inside follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Term-frequency saturation and length normalisation of BM25.
K1 = 1.2
B = 0.75
SHARD = 4096
BLOCK = 64
#: Vectors of a cell, about.
CELL = 128
#: Query blocks whose best rows a task keeps at a time.
KEPT = 16
POSTINGS = (
    "index_id string, shard long, term string, n int, places array<int>, tfs array<int>, dls array<int>, "
    "blocks array<int>, top_tf array<int>, low_dl array<int>"
)
FOUND = "index_id string, query_id string, shard long, place int, raw double, lex double, vec double"
_LISTS = ("places", "tfs", "dls", "blocks", "top_tf", "low_dl")


def gain(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    edges = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for v in values]


def _posting_rows(index_id: pa.Array, shard: pa.Array, terms: pa.Array, owner: np.ndarray, place: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    """owner: the term row of each posting, ascending; places ascending inside."""
    edges = np.searchsorted(owner, np.arange(len(terms) + 1))
    key = owner * (SHARD // BLOCK) + place // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, int)
    tops, lows = (np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)) if len(key) else (tf, dl)
    block_edges = np.searchsorted(owner[first], np.arange(len(terms) + 1))
    return pa.RecordBatch.from_arrays(
        [index_id, shard, terms, pa.array(np.diff(edges).astype(np.int32)), *_lists(edges, place, tf, dl),
         *_lists(block_edges, key[first] % (SHARD // BLOCK), tops, lows)],
        names=["index_id", "shard", "term", "n", *_LISTS])


def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(index_id, shard, place, terms, dl) rows, shard after shard, as posting rows."""
    waiting: list[pa.Table] = []
    key: tuple | None = None

    def rows() -> pa.RecordBatch:
        table = pa.concat_tables(waiting).combine_chunks()
        held = table["terms"].combine_chunks()
        coded = pc.dictionary_encode(held.flatten())
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = np.repeat(np.arange(table.num_rows), pc.list_value_length(held).to_numpy())
        pair, tf = np.unique(rank[coded.indices.to_numpy()] * SHARD + table["place"].to_numpy()[at], return_counts=True)
        length = np.ones(SHARD, np.int64)
        length[table["place"].to_numpy()] = np.maximum(1, table["dl"].to_numpy())
        words, n = coded.dictionary.take(order), len(order)
        return _posting_rows(
            pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), words, pair // SHARD, pair % SHARD, tf, length[pair % SHARD])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids, shards = table["index_id"].to_pylist(), table["shard"].to_numpy()
        new = [0, *(i for i in range(1, len(ids)) if shards[i] != shards[i - 1] or ids[i] != ids[i - 1]), len(ids)]
        for start, stop in zip(new, new[1:]):
            own = (ids[start], int(shards[start])) if stop > start else key
            if waiting and own != key:
                yield rows()
                waiting = []
            key = own
            if stop > start:
                waiting.append(table.slice(start, stop - start))
    if waiting:
        yield rows()


def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows with a bit mask of their shard's places, as posting rows of the places in it."""
    for batch in batches:
        held = {n: batch.column(n) for n in _LISTS[:3]}
        sizes = pc.list_value_length(held["places"]).to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        flat = {n: held[n].flatten().to_numpy() for n in held}
        raw = [np.frombuffer(m.as_buffer(), np.uint8)[: SHARD // 8] for m in batch.column("mask")]
        bits = np.stack(raw) if raw else np.zeros((0, SHARD // 8), np.uint8)
        keep = bits[owner, flat["places"] >> 3] >> (flat["places"] & 7) & 1 == 1
        left, rows = np.unique(owner[keep], return_inverse=True)
        take = pa.array(left)
        yield _posting_rows(
            batch.column("index_id").take(take), batch.column("shard").take(take), batch.column("term").take(take), rows,
            *(flat[n][keep].astype(np.int64) for n in _LISTS[:3]))


class _Shard:
    """The asked postings of a shard, ordered by the place of their term among a query block's terms."""

    def __init__(self, held: pa.StructArray, asked: pa.Array, average: float) -> None:
        code = pc.fill_null(pc.index_in(held.field("term"), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(code, kind="stable")
        self.edges = np.searchsorted(code[self.order], np.arange(len(asked) + 1))
        part = lambda name: held.field(name)
        self.starts, self.sizes = self._bounds(part("places"))
        self.block_starts, self.block_sizes = self._bounds(part("blocks"))
        flat = {n: part(n).values.to_numpy() for n in _LISTS}
        self.places, self.blocks = flat["places"], flat["blocks"]
        self.gains = gain(flat["tfs"], flat["dls"], average)
        self.tops = gain(flat["top_tf"], flat["low_dl"], average)

    @staticmethod
    def _bounds(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        edges = column.offsets.to_numpy().astype(np.int64)
        return edges[:-1], np.diff(edges)

    def entries(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting rows of some terms, and the weight of each."""
        count = self.edges[codes + 1] - self.edges[codes]
        return self.order[_ranges(self.edges[codes], count)], np.repeat(weights, count)

    def bounds(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a place of each block can score."""
        size = self.block_sizes[rows]
        at = _ranges(self.block_starts[rows], size)
        return np.bincount(self.blocks[at], np.repeat(np.maximum(weights, 0), size) * self.tops[at], minlength=SHARD // BLOCK)

    def scores(self, rows: np.ndarray, weights: np.ndarray, alive: np.ndarray | None) -> np.ndarray:
        size = self.sizes[rows]
        at = _ranges(self.starts[rows], size)
        each = np.repeat(weights, size)
        if alive is not None:
            keep = alive[self.places[at] // BLOCK]
            at, each = at[keep], each[keep]
        return np.bincount(self.places[at], each * self.gains[at], minlength=SHARD)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Queries:
    """A block of queries, and the rows found for each so far."""

    def __init__(self, row: dict) -> None:
        self.ids, self.index_id, self.average = row["q_ids"].values, row["index_id"].as_py(), row["avgdl"].as_py()
        coded = pc.dictionary_encode(row["q_terms"].values)
        self.asked, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.weights, self.edges = row["q_weights"].values.to_numpy(), row["q_offsets"].values.to_numpy()
        width = row["q_width"].as_py()
        self.matrix = np.frombuffer(row["q_matrix"].as_buffer()).reshape(len(self.ids), width) if width else None
        self.found: list[list[np.ndarray]] = [[] for _ in range(len(self.ids))]
        self.floor = np.full(len(self.ids), -np.inf)
        self.skipped = self.seen = 0

    def terms(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.edges[q], self.edges[q + 1])
        return self.codes[own], self.weights[own]

    def keep(self, q: int, shard: int, places: np.ndarray, raw: np.ndarray, limit: int) -> None:
        """Add rows to what was found for a query; its floor is the score that a new row must reach."""
        if not len(places):
            return
        own = self.found[q]
        own.append(_rows(shard, places, raw, raw, np.zeros(len(places))))
        known = np.concatenate([f[:, 2] for f in own])
        if len(known) >= limit:
            self.floor[q] = np.partition(known, len(known) - limit)[len(known) - limit]
            if len(known) > 8 * limit:
                every = np.concatenate(own)
                self.found[q] = [every[every[:, 2] >= self.floor[q]]]

    def emit(self) -> pa.RecordBatch:
        sizes = [sum(len(f) for f in own) for own in self.found]
        flat = np.concatenate([np.zeros((0, 5)), *(f for own in self.found for f in own)])
        return pa.RecordBatch.from_arrays(
            [pa.array([self.index_id] * len(flat), pa.string()), self.ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
             pa.array(flat[:, 0].astype(np.int64)), pa.array(flat[:, 1].astype(np.int32)), *(pa.array(flat[:, i]) for i in (2, 3, 4))],
            names=["index_id", "query_id", "shard", "place", "raw", "lex", "vec"])


def _rows(shard: int, places: np.ndarray, raw: np.ndarray, lex: np.ndarray, vec: np.ndarray) -> np.ndarray:
    # Shard numbers are below 2^53: partition * 2^33 // SHARD plus a row number.
    return np.column_stack([np.full(len(places), float(shard)), places, raw, lex, vec])


def best_lexical(queries: _Queries, shard: int, held: pa.StructArray, limit: int, digits: int) -> None:
    """The `limit` best scores above zero of each query in a shard; blocks that stay below what is known are not scored."""
    part = _Shard(held, queries.asked, queries.average)
    for q in range(len(queries.ids)):
        rows, weights = part.entries(*queries.terms(q))
        if not len(rows):
            continue
        bounds = part.bounds(rows, weights)
        floor = queries.floor[q]
        alive = (bounds > 0) & (bounds >= floor - 2 * 10.0**-digits)
        queries.seen += int((bounds > 0).sum())
        queries.skipped += int((bounds > 0).sum() - alive.sum())
        if not alive.any():
            continue
        score = np.round(part.scores(rows, weights, None if alive.all() else alive), digits)
        places = np.flatnonzero((score > 0) & (score >= floor))
        if len(places) > limit:
            cut = np.partition(score[places], len(places) - limit)[len(places) - limit]
            places = places[score[places] >= cut]
            # Equal scores: the first places, which hold the smallest ids of the shard.
            places = places[np.argsort(-score[places], kind="stable")[:limit]]
        queries.keep(q, shard, places, score[places], limit)


def cells(matrix: np.ndarray, rows: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a shard in cells: (order of rows, where each cell ends, centres, radii).

    A few rounds of k-means from evenly spaced rows. A radius is the largest distance from the centre, so an inner
    product with a row of the cell is at most that with the centre plus the query's length times the radius.
    """
    count = max(1, len(matrix) // rows)
    centres = matrix[np.linspace(0, len(matrix) - 1, count).astype(int)]
    for _ in range(4):
        gap = np.square(centres).sum(axis=1) - 2 * matrix @ centres.T
        own = gap.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, matrix)
        sizes = np.bincount(own, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    order = np.argsort(own, kind="stable")
    radii = np.zeros(count)
    np.maximum.at(radii, own, np.linalg.norm(matrix - centres[own], axis=1))
    return order, np.cumsum(sizes), centres, radii


def best_vector(
    queries: _Queries, shard: int, places: np.ndarray, matrix: np.ndarray, ends: np.ndarray, centres: np.ndarray, radii: np.ndarray,
    alive: np.ndarray | None, limit: int, digits: int,
) -> None:
    """The `limit` largest dot products above zero of each query; cells that cannot reach the best known ones are not scored."""
    q = queries.matrix
    bounds = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii + 10.0**-digits
    starts = np.append(0, ends[:-1])
    raw = np.full((len(q), len(places)), -np.inf)

    def score(wanted: np.ndarray) -> None:
        for c in np.flatnonzero(wanted.any(axis=0)):
            who, rows = np.flatnonzero(wanted[:, c]), slice(starts[c], ends[c])
            raw[who, rows] = np.round(q[who] @ matrix[rows].T, digits)

    def floors() -> np.ndarray:
        if alive is not None:
            raw[:, ~alive] = -np.inf
        if raw.shape[1] < limit:
            return queries.floor
        return np.maximum(queries.floor, np.partition(raw, raw.shape[1] - limit, axis=1)[:, raw.shape[1] - limit])

    filled = ends > starts
    first = np.zeros(bounds.shape, bool)
    first[np.arange(len(q)), np.where(filled, bounds, -np.inf).argmax(axis=1)] = True
    first &= bounds >= queries.floor[:, None]
    score(first)
    rest = ~first & filled & (bounds >= floors()[:, None]) & (bounds > 0)
    score(rest)
    queries.seen += int(filled.sum()) * len(q)
    queries.skipped += int(filled.sum()) * len(q) - int((first | rest).sum())
    floor = floors()
    for k in range(len(q)):
        at = np.flatnonzero((raw[k] > 0) & (raw[k] >= floor[k]))
        if len(at) > limit:  # equal scores: the smallest ids of the shard
            at = at[np.lexsort((places[at], -raw[k][at]))[:limit]]
        queries.keep(k, shard, places[at], raw[k][at], limit)


def skyband(lex: np.ndarray, vec: np.ndarray, keep: int, margin: float) -> np.ndarray:
    """Places that can be among the `keep` best of any weighted sum of the two scores, however each is scaled.

    A place is left out if `keep` others have at least its lex, and more than the margin above its vec: then
    they come before it whatever the weights and the rounding. Prefixes of the order by lex, twice as long each
    time, are tested: behind a prefix, a place needs a vec as high as the prefix's `keep`-th.
    """
    order = np.argsort(-lex, kind="stable")
    high = vec[order]
    stays = np.ones(len(lex), bool)
    size = keep
    while size < len(lex):
        bar = np.partition(high[:size], size - keep)[size - keep]
        stays[size:] &= high[size:] > bar - margin
        size *= 2
    return order[stays]


def best_hybrid(
    queries: _Queries, shard: int, held: pa.StructArray | None, places: np.ndarray, matrix: np.ndarray, keep: int, digits: int,
    weights: tuple[float, float],
) -> None:
    """Rows of a shard that can be among the `keep` best of both scores together.

    Where one score is nowhere above zero the other decides alone, and ids where both are: so the best of each
    alone stay too. Vectors have unit length at most, so a difference above the margin survives scaling and rounding.
    """
    part = _Shard(held, queries.asked, queries.average) if held is not None and len(held) else None
    dots = np.round(queries.matrix @ matrix.T, digits) + 0.0
    for q in range(len(queries.ids)):
        score = np.zeros(SHARD)
        if part is not None:
            rows, own = part.entries(*queries.terms(q))
            if len(rows):
                score = part.scores(rows, own, None)
        lex, vec = np.round(score[places], digits) + 0.0, dots[q]
        chosen = [np.lexsort((places, -lex))[:keep], np.lexsort((places, -vec))[:keep], places.argsort(kind="stable")[:keep]]
        if min(weights) > 0:
            chosen.append(skyband(lex, vec, keep, 4 * 10.0**-digits / weights[1]))
        at = np.unique(np.concatenate(chosen))
        queries.found[q].append(_rows(shard, places[at], np.zeros(len(at)), lex[at], vec[at]))


def search(find, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """find(queries, row) over rows that hold a shard beside a block of queries; what is found leaves once a block is done."""
    kept: dict[tuple, _Queries] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            key = row["index_id"].as_py(), row["q_ids"].values[0].as_py()
            if key not in kept:
                if len(kept) >= KEPT:
                    yield kept.pop(next(iter(kept))).emit()
                kept[key] = _Queries(row)
            find(kept[key], row)
    for queries in kept.values():
        yield queries.emit()

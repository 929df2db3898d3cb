"""Hashed text embeddings and vector arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .text import terms

# How a token reaches its bucket and sign.
DIMENSION = 256
EMPTY_TOKEN = "_"
BIGRAM_JOINT = "\x1f"
#: Rows that are hashed at a time, and adjacent pairs whose buckets a task remembers.
SLICE = 512
_CACHE_LIMIT = 1_000_000


class _Buckets:
    """Bucket and sign of every token: terms by number, adjacent pairs by the numbers of both."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.terms: list[str] = []
        self.single = np.zeros(0, np.int64)
        self.pairs, self.pair_slots = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slot(self, token: str) -> int:
        raw = hashlib.sha256(token.encode("utf-8")).digest()
        bucket = int.from_bytes(raw[:4], "big") % self.dimension
        return bucket + 1 if raw[4] & 1 else -bucket - 1

    def codes(self, flat: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(flat)
        words, new = coded.dictionary.to_pylist(), []
        for word in words:
            if word not in self.number:
                self.number[word] = len(self.terms)
                self.terms.append(word)
                new.append(self.slot(word))
        self.single = np.append(self.single, np.asarray(new, np.int64))
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked, back = np.unique(left << 32 | right, return_inverse=True)
        at = np.searchsorted(self.pairs, asked)
        inside = np.minimum(at, max(len(self.pairs) - 1, 0))
        missing = self.pairs[inside] != asked if len(self.pairs) else np.ones(len(asked), bool)
        new = asked[missing]
        slots = np.fromiter((self.slot(self.terms[p >> 32] + BIGRAM_JOINT + self.terms[p & 0xFFFFFFFF]) for p in new.tolist()), np.int64, len(new))
        self.pairs, self.pair_slots = np.insert(self.pairs, at[missing], new), np.insert(self.pair_slots, at[missing], slots)
        return self.pair_slots[np.searchsorted(self.pairs, asked)][back]


def _rows(held: pa.ListArray, known: _Buckets) -> pa.Array:
    """Vectors of some rows' terms, none where all cancels out."""
    if max(len(known.pairs), len(known.terms)) > _CACHE_LIMIT:
        known.clear()
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = known.codes(pa.concat_arrays([held.flatten(), pa.array([EMPTY_TOKEN])]))
    # A row without terms has the one token that stands for none.
    owner = np.append(np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(sizes == 0))
    single = known.single[np.append(flat[:-1], np.full(int((sizes == 0).sum()), flat[-1]))]
    follows = np.flatnonzero(owner[1 : sizes.sum()] == owner[: max(sizes.sum() - 1, 0)])
    slots = np.append(single, known.of_pairs(flat[follows], flat[follows + 1]))
    place = np.append(owner, owner[follows]) * known.dimension + np.abs(slots) - 1
    sums = np.bincount(place, np.sign(slots), len(sizes) * known.dimension).reshape(len(sizes), known.dimension)
    norm = np.sqrt((sums * sums).sum(axis=1))
    filled = norm > 0
    made = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(filled)) * known.dimension, pa.int32()), pa.array((sums[filled] / norm[filled][:, None]).ravel()))
    return pc.if_else(pa.array(filled), made, pa.scalar(None, made.type))


def _hash_tokens(dimension: int):
    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Buckets(dimension)
        for held in batches:
            made = [_rows(held.slice(at, SLICE), known) for at in range(0, len(held), SLICE)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return embed


def hash_embed(text: Column, dimension: int = DIMENSION) -> Column:
    """L2-normalised signed feature hash of terms and adjacent pairs; NULL when all cancels out."""
    return _hash_tokens(dimension)(terms(text))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))

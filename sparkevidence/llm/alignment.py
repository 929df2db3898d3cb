"""Alignment of two tokenizers over a corpus: groups of tokens with common ends, and links between overlapping tokens.

A is a byte-level vocabulary of the tokenizers library and gets a space before the text; B is a sentencepiece
model, which adds that space itself.

1. A text is cut where one white space (space or line feed) stands between other characters: neither tokenizer
   joins across such a place, so each unit, a white space and a word, has the same tokens in every text. A task
   remembers units and learns its new ones many at a time, as one text; a text that is not made of such units is
   a unit of its own.
2. Character offsets of A and spans of B give coarse token ends; where tokens share a character, or bytes stand
   for one, the ends between are refined with the tokens' decoded bytes. Texts whose joined token bytes are not
   the text have no tokens.
3. The union of both tokenizers' ends cuts a text into ranges, each within one token of A and one of B: the
   links. The ends that both have cut it into groups.
4. Texts of a task are gathered into blocks of about `block_units` units. A block keeps its different id pairs
   with their numbers, the pairs of each different unit, and the units of each text as small numbers. Blocks go
   to the shared folder.
5. Pairs are summed over all blocks, the highest sum of each B id is found, and both go back to the blocks that
   hold the pair; a block then adds up its units, then its texts. Nothing of the pair table is broadcast or collected.

Defined cases: null and empty texts, and texts that either tokenizer changes, have zeros and an empty
groups_sha256; repeated rows count each for themselves; null keys pass through; an empty table gives an empty
result; a text longer than a block is a block of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, in_arrow, in_wide_arrow, stage, steps, texts_of

#: Units of one block.
BLOCK_UNITS = 2_000_000
#: Units that a task remembers, and that it learns in one call.
REMEMBERED, LEARNT = 400_000, 8192
#: A pair of ids is one number: A * _PAIR + B.
_PAIR = 1 << 32
_SPACE = "▁"
#: A space or line feed, then no white space of any kind (U+180E was one).
_split = re.compile("[ \n][^\\s\u180e]+").findall


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each token and their numbers, and the ids in writing with what follows them."""

    def __init__(self, tokens: list[bytes], inner: str, last: str) -> None:
        self.bytes = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        #: First half: inside its side of a group; second half: last there.
        self.written = np.array([f"{i}{c}" for c in (inner, last) for i in range(len(tokens))], object)


def refine(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens of a text from coarse byte spans and decoded sizes.

    A coarse end counts where it lies behind the one before and not behind the next start; tokens between such
    ends share a character, and their ends follow from the decoded bytes.
    """
    if not len(ends):
        return ends
    sure = (np.diff(ends, prepend=0) > 0) & (np.append(starts[1:], ends[-1]) >= ends)
    summed = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(ends)), -1))
    return np.where(sure, ends, summed - np.where(last >= 0, summed[last] - ends[last], 0))


def _bytes_before(text: str) -> np.ndarray:
    """Bytes before each character, and of all."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))


class Units:
    """What a worker knows of units: a number for each, and columns by number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.counts: list[np.ndarray] = []  # a row (n_a, n_b, n_groups, n_links, fits) for each unit
        self.written: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.size = 0

    def add(self, counts: np.ndarray, written: list[str], pairs: np.ndarray) -> None:
        self.counts.append(counts)
        self.written += written
        self.pairs.append(pairs)
        self.size += len(counts)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts and all pairs, unit after unit."""
        self.counts = [np.concatenate([np.zeros((0, 5), np.int64), *self.counts])]
        self.pairs = [np.concatenate([np.zeros(0, np.int64), *self.pairs])]
        return self.counts[0], self.pairs[0]


class Aligner:
    """Both tokenizers in one Python worker."""

    def __init__(self, byte_vocabulary: str, piece_model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_vocabulary)
        self.first.encode_special_tokens = True
        byte = byte_level()
        entries: list[bytes] = [b""] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.a = Vocabulary(entries, ",", "|")
        self.second = SentencePieceProcessor(model_file=piece_model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b = Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)], ",", ";")
        # Units hold only where no piece goes on behind a white space.
        self.apart = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        self.units = Units()

    def _tokens(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both sides of a text that begins with a space; None if a side changes it."""
        e = self.first.encode(text, add_special_tokens=False)
        found = [(p.id, p.begin, p.end) for p in self.second.encode(text[1:], return_type="proto").pieces]
        if b"".join(map(self.a.bytes.__getitem__, e.ids)) != raw or b"".join([self.b.bytes[i] for i, _, _ in found]) != raw:
            return None
        a, spans = np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)
        if len(raw) != len(text):
            spans = _bytes_before(text)[spans]
        # Spans of B count bytes of the text without the added space.
        at = np.array(found, np.int64).reshape(-1, 3)
        return a, refine(spans[:, 0], spans[:, 1], self.a.sizes[a]), at[:, 0], refine(at[:, 1] + 1, at[:, 2] + 1, self.b.sizes[at[:, 0]])

    def _learn(self, parts: list[str]) -> None:
        """Append units to the known ones: parts of one text that begins with a space, aligned together."""
        text = "".join(parts)
        raw = text.encode()
        tokens = self._tokens(text, raw)
        sizes = np.array([len(p) for p in parts] if len(raw) == len(text) else [len(p.encode()) for p in parts], np.int64)
        edges = np.cumsum(sizes)
        if tokens is not None:
            a, a_ends, b, b_ends = tokens
            upto_a, upto_b = np.searchsorted(a_ends, edges, "right"), np.searchsorted(b_ends, edges, "right")
            if (a_ends[upto_a - 1] == edges).all() and (b_ends[upto_b - 1] == edges).all():
                return self._cut(a, a_ends, b, b_ends, edges, upto_a, upto_b)
        if len(parts) == 1:
            return self.units.add(np.zeros((1, 5), np.int64), [""], np.zeros(0, np.int64))
        # Some unit is changed by a tokenizer: each for itself.
        for part in parts:
            self._learn([part]) if part[0] == " " else self._behind_space(part)

    def _behind_space(self, part: str) -> None:
        """A unit that begins with a line feed, learnt behind another one that is then forgotten."""
        before = self.units
        self.units = Units()
        self._learn([" x", part])
        counts, pairs = self.units.table()
        written, self.units = self.units.written, before
        before.add(counts[1:], written[1:], pairs[counts[0, 3] :])

    def _cut(self, a, a_ends, b, b_ends, edges, upto_a, upto_b) -> None:
        """Groups and links of a text, by unit."""
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        links = ends[np.append(ends[1:] != ends[:-1], True)]
        common = ends[1:][ends[1:] == ends[:-1]]
        pairs = a[np.searchsorted(a_ends, links)] * _PAIR + b[np.searchsorted(b_ends, links)]
        # Tokens up to each common end; the writing of a token stands behind all of A and B of earlier groups,
        # and that of B also behind A of its own group.
        behind_a, behind_b = np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[behind_a - 1] = 1
        last_b[behind_b - 1] = 1
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.append(0, behind_b)[np.searchsorted(common, a_ends)]] = self.a.written[a + last_a * len(self.a.bytes)]
        text[np.arange(len(b)) + behind_a[np.searchsorted(common, b_ends)]] = self.b.written[b + last_b * len(self.b.bytes)]
        flat, stops = text.tolist(), (upto_a + upto_b).tolist()
        upto = [upto_a, upto_b, np.searchsorted(common, edges, "right"), np.searchsorted(links, edges, "right")]
        counts = np.column_stack([*(np.diff(x, prepend=0) for x in upto), np.ones(len(edges), np.int64)])
        self.units.add(counts, ["".join(flat[s:e]) for s, e in zip([0, *stops], stops)], pairs)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's units; new units of all texts are learnt first."""
        known = self.units.number
        split = [_split(" " + t) if self.apart and _SPACE not in t else None for t in texts]
        split = [s if s and sum(map(len, s)) == len(t) + 1 else None for s, t in zip(split, texts)]
        new = [u for u in set().union(*(s for s in split if s)) if u not in known]
        # A text begins with a space, so a unit of that kind comes first.
        new.sort(key=lambda u: u[0] != " ")
        if new and new[0][0] != " ":
            new.insert(0, " x")
        for at in range(0, len(new), LEARNT):
            some = new[at : at + LEARNT]
            if some[0][0] != " ":
                for unit in some:
                    known[unit] = self.units.size
                    self._behind_space(unit)
                continue
            known.update(zip(some, range(self.units.size, self.units.size + len(some))))
            self._learn(some)
        out = []
        for text, own in zip(texts, split):
            if own is None and text:
                out.append(np.array([self.units.size]))
                self._learn([" " + text])
            else:
                out.append(np.fromiter(map(known.__getitem__, own or ()), np.int64, len(own or ())))
        return out


def blocks(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text", block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row for each block: its texts, its different pairs with their numbers, the pairs of each different unit
    (places in that list), and the units of all texts, most frequent first (little-endian unsigned 32-bit)."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["block", "keys", "n_a", "n_b", "n_groups", "n_links", "sizes", "sha", "pairs", "counts", "unit_sizes", "unit_pairs", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("aligner", byte_vocabulary, piece_model), lambda: Aligner(byte_vocabulary, piece_model))
        keys: list[pa.Array] = []
        rows: list[tuple[int, int, int, int, int]] = []
        shas: list[str] = []
        stream: list[np.ndarray] = []
        made = waiting = 0

        def block() -> pa.RecordBatch:
            counts, all_pairs = aligner.units.table()
            codes, seen = pd.factorize(np.concatenate([np.zeros(0, np.int64), *stream]))
            times = np.bincount(codes, minlength=len(seen))
            order = np.argsort(-times, kind="stable")
            seen, times = seen[order], times[order]
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            sizes = counts[seen, 3]
            starts = np.append(0, np.cumsum(counts[:, 3]))[seen]
            taken = all_pairs[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            pair_codes, pairs = pd.factorize(taken)
            number = np.zeros(len(pairs), np.int64)
            np.add.at(number, pair_codes, np.repeat(times, sizes))
            own_keys = pa.concat_arrays(keys)
            at = np.array(rows, np.int64).reshape(-1, 5)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
            return pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 24 | made], pa.int64()), one(own_keys), *(one(at[:, i]) for i in range(5)),
                one(pa.array(shas, pa.string())), one(pairs.astype(np.int64)), one(number),
                *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (sizes, pair_codes, place[codes])),
            ], names=names)

        for batch in batches:
            for part in steps(batch, "text"):
                keys.append(part.column("key"))
                found = aligner.numbers(texts_of(part, "text"))
                counts, _ = aligner.units.table()
                written = aligner.units.written
                for own in found:
                    n = counts[own].sum(axis=0)
                    if not len(own) or n[4] < len(own):  # empty, or changed by a tokenizer
                        rows.append((0, 0, 0, 0, 0))
                        shas.append("")
                        continue
                    rows.append((*n[:4].tolist(), len(own)))
                    shas.append(hashlib.sha256("".join([written[i] for i in own])[:-1].encode()).hexdigest())
                    stream.append(own)
                    waiting += len(own)
                if waiting >= block_units or aligner.units.size > REMEMBERED:
                    yield block()
                    keys, rows, shas, stream, made, waiting = [], [], [], [], made + 1, 0
                    if aligner.units.size > REMEMBERED:
                        aligner.units = Units()
        if rows:
            yield block()

    lists = ", ".join(f"{n} array<long>" for n in names[2:7])
    binary = ", ".join(f"{n} binary" for n in names[10:])
    return in_arrow(source, run, f"block long, keys array<{kind}>, {lists}, sha array<string>, pairs array<long>, counts array<long>, {binary}")


def align(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text", block_units: int = BLOCK_UNITS,
) -> DataFrame:
    """Per row: tokens of both sides, groups and their digest, links, links with the best pair of their B id, and
    the sum of all links' pair counts."""
    made, _ = stage(blocks(docs, byte_vocabulary, piece_model, key, text, block_units), "alignment", wide_rows=True)
    held_pairs = made.select("block", F.posexplode(F.arrays_zip("pairs", "counts"))).select(
        "block", F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    sums = held_pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    second = F.col("pair").bitwiseAND(F.lit(_PAIR - 1))
    best = sums.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(second)))
    back = held_pairs.select("block", "place", "pair").join(best, "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("found"))
    joined = made.drop("pairs", "counts").join(
        back.select("block", F.col("found.total").alias("total"), F.col("found.best").alias("best")), "block", "left")
    kind = docs.schema[key].dataType.simpleString()
    shown = ("keys", "n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                numbers = {n: np.frombuffer(row[n].as_buffer(), "<u4").astype(np.int64) for n in ("unit_sizes", "unit_pairs", "units")}
                sums = []
                for name in ("best", "total"):
                    values = row[name].values.to_numpy(zero_copy_only=False).astype(np.int64) if row[name].is_valid else np.zeros(0, np.int64)
                    of_unit = _added(values[numbers["unit_pairs"]], numbers["unit_sizes"])
                    sums.append(pa.array(_added(of_unit[numbers["units"]], row["sizes"].values.to_numpy())))
                yield pa.RecordBatch.from_arrays(
                    [*(row[n].values for n in shown), *sums, row["sha"].values],
                    names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    fields = ", ".join(f"{n} long" for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return in_wide_arrow(joined, run, f"`{key}` {kind}, {fields}, groups_sha256 string")


def _added(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    running, edges = np.append(0, np.cumsum(values)), np.append(0, np.cumsum(sizes))
    return running[edges[1:]] - running[edges[:-1]]

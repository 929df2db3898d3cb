"""Language-model scoring with a weighted backoff automaton whose counts never leave the shuffle.

Model. States are the histories seen in training; an arc for each seen continuation carries the log of its
smoothed probability, and a failure arc carries the backoff weight to the next shorter history:
    p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu),   p(w) = (c(w) + 1) / (N + V + 1).
For an unseen continuation this is exactly failure weight times p(w | h'). A text is read once from left
to right: its state follows the arc of the next word, or failure arcs down to a state that has one, and the
weights on the way add up. All texts of a block take a step together, the longest ones to the last.

Jobs.
1. One pass over the texts turns blocks of about `BLOCK_TOKENS` tokens into word codes and sorted lists of
   hashed n-grams with their training counts, and writes them to the shared folder. Words are kept as
   64-bit hashes; a word of a third of all tokens is one entry of each block.
2. The n-gram lists are cut by ranges of the hash, shuffled and merged: each range adds up its counts and
   sends every block the totals of the entries that the block asked for.
3. Blocks meet their totals, from which each builds the part of the automaton that its texts can reach: states,
   arcs and failure arcs. Then its texts are read.
Tasks hold one block or one range, both of bounded size; nothing of the model is broadcast or collected
but N and V. The model grows with the corpus.

Defined cases: null and empty texts hold the end token alone; texts with a null id are held out;
repeated rows count and are scored each; an empty table gives an empty result; a text longer than a block
is a block of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, in_arrow, stage, steps, texts_of

BLOCK_TOKENS = 1_500_000
#: Entries that one range merges, about.
RANGE_ENTRIES = 2_000_000
ORDER = 2
MU = 500.0
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes of the end token (no word is empty) and of the history before the first word.
_END = xxhash.xxh64_intdigest(b"")
_BEGIN = xxhash.xxh64_intdigest(b" ")
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _squeeze(values: np.ndarray) -> bytes:
    """Values as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.Codec("zstd").compress(planes, asbytes=True) if values.size else b""


def _expand(blob: bytes, kind: type, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=count * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, count).T).view(kind).reshape(-1)


def _chained(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its history and that of its last word."""
    x = history * _FACTOR + word
    return (x ^ x >> np.uint64(29)) * _MIX


def gram_hashes(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For orders 1, 2, ...: the hash of the n-gram that ends at each token, 0 where a text is too young."""
    starts = np.cumsum(lengths) - lengths
    age = np.arange(len(words)) - np.repeat(starts, lengths)
    out = [words]
    for n in range(2, order + 1):
        shorter = out[-1] if n == 2 else out[n - 2]
        before = np.roll(shorter, 1)
        if n == 2:
            before[age == 0] = _BEGIN
        grams = _chained(before, words)
        grams[age < n - 2] = 0
        out.append(grams)
    return out


def encode(docs: DataFrame, key: str, text: str, held_out: Column, order: int, block_tokens: int) -> DataFrame:
    """Rows of kind docs (codes of a block) and of kind grams (its n-grams of one order with counts)."""
    source = docs.select(F.col(f"`{key}`").alias("id"), held_out.alias("held"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"kind string, block long, ids array<{id_type}>, held array<boolean>, lengths array<long>, n long, codes binary, hashes binary, counts binary, `order` int"
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    kinds = [pa.string(), pa.int64(), pa.list_(arrow_id), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    names = ["kind", "block", "ids", "held", "lengths", "n", "codes", "hashes", "counts", "order"]

    def rows(block: int, ids: list, held: list, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts)
        learned = np.repeat(~np.array(held, bool), lengths)
        distinct, codes, times = np.unique(words, return_inverse=True, return_counts=True)
        rank = np.empty(len(distinct), np.int64)
        by_use = np.argsort(-times, kind="stable")
        rank[by_use] = np.arange(len(distinct))
        # Frequent words get small codes; the number of different words stands in n.
        out = [("docs", block, ids, held, lengths, len(distinct), _squeeze(rank[codes].astype(np.uint32)), _squeeze(distinct[by_use]), None, None)]
        for n, grams in enumerate(gram_hashes(words, lengths, order), 1):
            if n == 1:
                known, at = distinct, codes
            else:
                known, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(at[learned], minlength=len(known)).astype(np.uint32)
            out.append(("grams", block, None, None, None, len(known), None, _squeeze(np.diff(known, prepend=np.uint64(0))), _squeeze(counts), n))
        for row in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, size, block = [], [], [], 0, None
        for batch in batches:
            for part in steps(batch, "text"):
                if block is None:
                    block = part.column("part")[0].as_py() << 24
                for i, h, t in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), texts_of(part, "text")):
                    words = t.encode().translate(_LOWER).split()
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                    ids.append(i)
                    held.append(h)
                    parts.append(np.append(hashes, np.uint64(_END)))
                    size += len(parts[-1])
                    if size >= block_tokens:
                        yield from rows(block, ids, held, parts)
                        ids, held, parts, size, block = [], [], [], 0, block + 1
        if parts:
            yield from rows(block, ids, held, parts)

    return in_arrow(source, run, schema)


def totals(grams: DataFrame, ranges: int) -> DataFrame:
    """For each block, order and range: corpus totals of the block's entries, in order of their hashes.

    seen and sum are the range's number of entries with a count and their sum, the same in all its rows.
    """
    cut_names = ["order", "range", "block", "n", "hashes", "counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                known = np.cumsum(_expand(row["hashes"], np.uint64, row["n"]), dtype=np.uint64)
                counts = _expand(row["counts"], np.uint32, row["n"])
                at = [0, *np.searchsorted(known, edges).tolist(), len(known)]
                out = [
                    (row["order"], k, row["block"], b - a, _squeeze(np.diff(known[a:b], prepend=np.uint64(0))), _squeeze(counts[a:b]))
                    for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                columns = list(zip(*out))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=cut_names)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = np.concatenate([np.cumsum(_expand(r["hashes"], np.uint64, r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([_expand(r["counts"], np.uint32, r["n"]) for r in rows])
        order = np.argsort(known)
        new = np.concatenate([[True], known[order][1:] != known[order][:-1]])
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        each = np.empty(len(known), np.int64)
        each[order] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([r["n"] for r in rows])
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()), "order": pa.array([r["order"] for r in rows], pa.int32()),
            "range": pa.array([r["range"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int64()),
            "sums": pa.array([_squeeze(each[b - r["n"] : b]) for r, b in zip(rows, ends)], pa.binary()),
            "seen": pa.array([int((sums > 0).sum())] * len(rows), pa.int64()), "sum": pa.array([int(sums.sum())] * len(rows), pa.int64()),
        })

    cuts = in_arrow(grams.select("order", "block", "n", "hashes", "counts"), cut, "`order` int, `range` int, block long, n long, hashes binary, counts binary")
    return cuts.groupBy("order", "range").applyInArrow(merge, "block long, `order` int, `range` int, n long, sums binary, seen long, sum long")


class Automaton:
    """The states and arcs that the texts of a block can reach.

    States are numbered: 0 is the empty history, then histories of one word (seen ones, and the beginning of a
    text), then longer ones. Arcs of histories of n - 1 words are found by the hash of the n-gram they complete.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, counts: list[np.ndarray], texts: int, mass: float, mu: float) -> None:
        """counts[k]: training count of the (k+1)-gram that ends at each token; texts: training texts; mass: N + V + 1."""
        self.order = len(counts)
        self.starts = np.cumsum(lengths) - lengths
        age = (np.arange(len(words)) - np.repeat(self.starts, lengths)).astype(np.int32)
        grams = gram_hashes(words, lengths, self.order)
        # Of each different n-gram one place in the texts stands for all.
        self.words, first, self.word = np.unique(words, return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        p = (counts[0] + 1) / mass
        self.arcs = [np.log10(p[first])]
        self.keys: list[np.ndarray] = [self.words]
        hashes, fails, weights, level = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        size = 1
        # States of one word: the words seen in training; the beginning stands behind them.
        number = np.zeros(len(words), np.int32)  # the state of the history of n words that ends at each token
        ends: list[np.ndarray] = []  # where an arc leads
        for n in range(1, self.order + 1):
            if n > 1:
                history = np.roll(counts[n - 2], 1).astype(float)
                if n == 2:
                    history[age == 0] = texts
                p = np.where(age >= n - 2, (counts[n - 1] + mu * p) / (history + mu), p)
                known, first = np.unique(grams[n - 1], return_index=True)
                seen = (counts[n - 1][first] > 0) & (age[first] >= n - 2)
                known, first = known[seen], first[seen]
                self.keys.append(known)
                self.arcs.append(np.log10(p[first]))
            else:
                known, first = self.words, first
            if n < self.order:
                is_state = counts[n - 1][first] > 0
                own = np.where(is_state, size + np.cumsum(is_state) - 1, 0).astype(np.int32)
                hashes.append(known[is_state])
                fails.append(number[first][is_state])
                weights.append(np.log10(mu / (counts[n - 1][first][is_state] + mu)))
                level.append(np.full(int(is_state.sum()), n))
                size += int(is_state.sum())
                # A token whose n-gram is no state keeps the longest shorter one.
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams[n - 1]), len(known) - 1)
                    longer = np.where(known[at] == grams[n - 1], own[at], 0)
                    number = np.where(longer > 0, longer, number)
            ends.append(number[first])
            grams[n - 1] = words  # no longer needed
        self.ends = ends
        self.begin = size
        self.hash = np.concatenate([*hashes, np.array([_BEGIN], np.uint64)])
        self.fail = np.concatenate([*fails, np.zeros(1, np.int64)])
        self.weight = np.concatenate([*weights, np.array([np.log10(mu / (texts + mu))])])
        self.level = np.concatenate([*level, np.ones(1, np.int64)])
        self.lengths, self.tokens = lengths, words

    def read(self) -> np.ndarray:
        """log10 probability of each text."""
        by_length = np.argsort(-self.lengths, kind="stable")
        starts, lengths = self.starts[by_length], self.lengths[by_length]
        total, state = np.zeros(len(lengths)), np.full(len(lengths), self.begin)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -step, "left"))
            at = starts[:active] + step
            word, now, gained = self.tokens[at], state[:active], np.zeros(active)
            following, waits = np.zeros(active, np.int64), np.arange(active)
            for n in range(self.order, 1, -1):
                own = waits[self.level[now[waits]] == n - 1]
                if not len(own):
                    continue
                keys = self.keys[n - 1]
                wanted = _chained(self.hash[now[own]], word[own])
                spot = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                hit = keys[spot] == wanted if len(keys) else np.zeros(len(own), bool)
                done, missed = own[hit], own[~hit]
                gained[done] += self.arcs[n - 1][spot[hit]]
                following[done] = self.ends[n - 1][spot[hit]]
                gained[missed] += self.weight[now[missed]]
                now[missed] = self.fail[now[missed]]
                keep = np.ones(active, bool)
                keep[done] = False
                waits = waits[keep[waits]]
            spot = self.word[at[waits]]
            gained[waits] += self.arcs[0][spot]
            following[waits] = self.ends[0][spot]
            total[:active] += gained
            state[:active] = following
        out = np.empty(len(total))
        out[by_length] = total
        return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, order: int = ORDER,
          mu: float = MU, block_tokens: int = BLOCK_TOKENS, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    from .classifier import remainder

    spark = docs.sparkSession
    held_out = remainder(key, 7) == 2 if held_out is None else held_out
    encoded, path = stage(encode(docs, key, text, F.coalesce(held_out, F.lit(True)), order, block_tokens), "lm", "kind")
    grams = encoded.filter("kind = 'grams'")
    entries = grams.groupBy("order").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    answers, _ = stage(totals(grams, max(1, -(-entries // range_entries))), "totals")
    drop_staged(spark, f"{path}/kind=grams")
    one = answers.filter(F.col("order") == 1).groupBy("range").agg(F.first("seen").alias("seen"), F.first("sum").alias("sum"))
    seen, tokens = one.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))).first()
    mass = tokens + seen + 1

    codes = spark.read.schema(encoded.drop("kind").schema).parquet(f"{path}/kind=docs") if entries else encoded
    id_type = encoded.schema["ids"].dataType.elementType.simpleString()
    gathered = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "range", "n", "sums"))).alias("answers"))
    rows = codes.select("block", "ids", "held", "lengths", "n", "codes", "hashes").join(gathered, "block")
    learned = codes.select(F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + F.when(h, 0).otherwise(1)).alias("n")).agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = np.array(row.column("lengths")[0].as_py(), np.int64)
                size = int(lengths.sum())
                hashes = _expand(row.column("hashes")[0].as_py(), np.uint64, row.column("n")[0].as_py())
                words = hashes[_expand(row.column("codes")[0].as_py(), np.uint32, size)]
                found: dict[int, list[np.ndarray]] = {}
                for a in row.column("answers")[0].as_py():
                    found.setdefault(a["order"], []).append(_expand(a["sums"], np.int64, a["n"]))
                counts = []
                for n, grams in enumerate(gram_hashes(words, lengths, order), 1):
                    counts.append(np.concatenate(found[n])[np.unique(grams, return_inverse=True)[1]])
                starts = np.cumsum(lengths) - lengths
                base = np.log10((counts[0] + 1) / mass)
                own = Automaton(words, lengths, counts, learned, mass, mu).read()
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("ids").flatten(), row.column("held").flatten(), pa.array(lengths),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), tokens, np.int64)),
                        pa.array(np.add.reduceat(base, starts)), pa.array(own),
                    ],
                    names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return in_arrow(
        rows, run, f"`{key}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Best-fit packing of token sequences by minimum bin slack over the histogram of piece lengths.

1. One pass over the texts tokenizes, cuts texts longer than a sequence into pieces and numbers the
   pieces of each length inside a task (counters of at most `capacity` entries). The pieces, without
   their texts, go to the shared folder.
2. The histogram of lengths has at most `capacity` rows, whatever the size of the corpus, so the driver
   may hold it. Minimum bin slack works on it: for the next bin, a subset-sum over bit sets finds the
   fullest combination of the lengths left that holds the longest of them; that combination is removed
   as often as the counts allow, in one step. A step uses up a length or leaves fewer of it than one bin
   takes, so the number of steps is bounded by the capacity too, not by the documents.
3. Pieces find their place by their number among the pieces of equal length: counts for each (length,
   task) are summed up to the first number of each task, and a piece's number falls into the range that
   one of the combinations took from that length.

Defined cases: a null text is the empty text (one piece, the closing id alone); repeated rows are packed
each for themselves; null ids pass through; an empty table gives an empty result; ties between equal
lengths are broken by the order of reading, which changes the placing but not the number of sequences;
very long texts are cut and every piece but the last is full. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, in_arrow, stage, steps, texts_of

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers; the memory is emptied when it is full.
_REMEMBERED = 800_000
#: Sequences of letters whose ids a task remembers.
_REMEMBERED_LETTERS = 700_000
_LONGEST_REMEMBERED = 64
#: Words encoded in one call; an encoding holds far more than its ids.
_ENCODED = 2048
_MARKS = b".,!?;:%$#&*|"
#: Latin letters (UTF-8; those that stay one letter when lower-cased), then any marks.
_letters_and_marks = re.compile(
    rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])++)"
    rb"([.,!?;:%$#&*|]*+)").fullmatch


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so the ids of a text are
    those of its words in order; each different word is looked up once and kept as little-endian bytes.
    A word of Latin letters followed by marks is two pre-tokens, so its letters (A-Z lowered, as the
    vocabulary does) and its marks are learnt apart. Letters are encoded many at a time as one text: each
    is one pre-token and ends with the only end-of-word id that it has.
    """

    def __init__(self, path: str) -> None:
        # One Spark task, one thread: the library's own pool would spin beside the other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        self._ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self._ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        self._letters: dict[bytes, bytes] = {}
        self._marks: dict[bytes, bytes] = {b"": b""}

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), _ENCODED):
            some = words[at : at + _ENCODED]
            found = self._encode([w.decode() for w in some], add_special_tokens=False)
            out |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(some, found)}
        return out

    def _joined(self, letters: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for at in range(0, len(letters), _ENCODED):
            some = letters[at : at + _ENCODED]
            ids = np.array(self._encode([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            out |= {w: raw[a:b] for w, a, b in zip(some, [0, *ends], ends)} if len(ends) == len(some) else self._each(some)
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        letters, marks = self._letters, self._marks
        if len(letters) > _REMEMBERED_LETTERS:
            letters.clear()
        out: dict[bytes, bytes] = {}
        pending, rest = [], []
        for w in words:
            own = w.rstrip(_MARKS)
            if own.isalpha():  # A-Z and a-z alone: the pattern need not be asked
                own, mark = own.lower(), w[len(own) :]
            elif found := _letters_and_marks(w):
                own, mark = found[1].lower(), found[2]
            else:
                rest.append(w)
                continue
            if (ids := letters.get(own)) is None or (tail := marks.get(mark)) is None:
                pending.append((w, own, mark))
            else:
                out[w] = ids + tail
        letters |= self._joined([c for c in {c for _, c, _ in pending} if c not in letters])
        out |= self._each(rest)
        if len(marks) > _ENCODED:
            marks.clear()
            marks[b""] = b""
        marks |= self._each([m for m in {m for *_, m in pending} if m not in marks])
        for w, own, mark in pending:
            out[w] = letters[own] + marks[mark]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; new words of all texts are learnt together."""
        split = [t.encode().split() for t in texts]
        known = self._known
        if len(known) > _REMEMBERED:
            known.clear()
        # One look at each word: what is not known yet is learnt, and only its places are filled afterwards.
        found = [list(map(known.get, words)) for words in split]
        gaps = [list(compress(count(), map(is_, ids, repeat(None)))) for ids in found]
        new = list({words[i] for words, places in zip(split, gaps) for i in places})
        known |= self._learn(new)
        for words, ids, places in zip(split, found, gaps):
            for i in places:
                ids[i] = known[words[i]]
        for w in [w for w in new if len(w) > _LONGEST_REMEMBERED]:
            del known[w]
        return list(map(b"".join, found))


def tokenize(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces: key, piece, start, length, ids_crc32, and (block, nth): its number among the pieces of
    this length in one task. Writes nothing; the numbers hold for one evaluation, so stage the result."""
    names = [key, "piece", "start", "length", "ids_crc32", "block", "nth"]
    end = np.asarray([end_id], "<u4").tobytes()
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), F.spark_partition_id().alias("__block"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What one task has learnt serves the next one in the same worker.
        tokenizer = held(("tokenizer", vocabulary), lambda: WordTokenizer(vocabulary))
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in steps(batch, text):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, own in enumerate(tokenizer.ids(texts_of(part, text))):
                    ids = memoryview(own + end)
                    count = len(ids) // 4
                    for piece, start in enumerate(range(0, count, capacity)):
                        length = min(capacity, count - start)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows.append((i, piece, start, length, crc, used[length]))
                        used[length] += 1
                at = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2]),
                        pa.array(at[:, 3]), pa.array(at[:, 4]), part.column("__block").take(pa.array(at[:, 0])), pa.array(at[:, 5]),
                    ],
                    names=names,
                )

    return in_arrow(source, run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long")


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of lengths that holds the longest one: length -> how many of it.

    Reachable sums are the bits of a whole number; a length that is there several times is added in
    doubling bundles. Long lengths come first, and the search ends when the bin can be filled exactly.
    """
    longest = max(left)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted(left, reverse=True):
        if length > room:
            continue
        count = min(left[length] - (length == longest), room // length)
        bundle = 1
        while count > 0:
            take = min(bundle, count)
            wider = (reach | reach << take * length) & mask
            if wider != reach:
                trail.append((length, take, reach))
                reach = wider
            count -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, take, before in reversed(trail):
        if total == 0:
            break
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins get it) until no piece is left."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // m for n, m in chosen.items())
        plan.append((chosen, times))
        for n, m in chosen.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan


def ranges(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers up to, first bin, pieces in a bin, offset of the first of them)."""
    taken: dict[int, int] = {}
    out, first_bin = [], 0
    for chosen, times in plan:
        offset = 0
        for n in sorted(chosen, reverse=True):
            m, start = chosen[n], taken.get(n, 0)
            out.append((n, start, start + m * times, first_bin, m, offset))
            taken[n] = start + m * times
            offset += m * n
        first_bin += times
    return out


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences hold at most `capacity` ids."""
    spark = docs.sparkSession
    pieces, _ = stage(tokenize(docs, vocabulary, key, text, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placing = spark.createDataFrame(
        ranges(plan_bins(histogram, capacity)), "length long, low long, high long, first_bin long, per_bin long, shift long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One array of ranges for each length: both the lengths and the ranges are bounded by the capacity.
    table = placing.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first_bin", "per_bin", "shift"))).alias("slots"))
    numbered = pieces.join(firsts, ["length", "block"]).withColumn("number", F.col("base") + F.col("nth"))
    slot = F.element_at(F.filter("slots", lambda s: (F.col("number") >= s["low"]) & (F.col("number") < s["high"])), 1)
    inside = F.col("number") - F.col("slot.low")
    return numbered.join(F.broadcast(table), "length").withColumn("slot", slot).select(
        F.col(f"`{key}`"), "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_bin") + F.expr("(number - slot.low) div slot.per_bin")).alias("sequence_id"),
        (F.col("slot.shift") + inside % F.col("slot.per_bin") * F.col("length")).alias("offset"),
    )

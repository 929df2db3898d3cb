"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

Index. Items are cut into entries of at most `ENTRY` words; an entry's impact for a term is its BM25 weight
divided by the entry's weight against itself, so a score lies between 0 and 1. Word frequencies are
counted over all items by a grouped aggregate. Items are indexed in blocks of a bounded size, one pass
over the texts for each block; a block's index is the only thing that is sent to the tasks.

Search (block-max WAND over many passages at once). A passage is two halves of `ENTRY` words, starting
every `ENTRY` words, so any entry that stands in a text lies whole in a passage.
1. The commonest terms whose impacts together stay below a share of the threshold in every entry are
   non-essential: no entry reaches the threshold by them alone (the pivot of WAND).
2. For each passage and block of entries, the block maxima of its essential terms are added up; where
   they cannot reach what the block's entries still need, the whole block is skipped.
3. The entries of the remaining blocks are scored in full; all at or above the threshold are retrieved.
4. Question and answer of the item must then overlap with the passage in word trigrams.

Defined cases: null and empty texts hold no passage; items without words are never found; items of fewer
than `SHORT` words count only if they stand in the text word for word; repeated rows and equal items are
each reported; null ids pass through; ties need no rule as everything above the threshold is returned;
an empty table on either side gives no row; only ids and texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow, map_texts, stage, steps, texts_of

ENTRY = 64
#: Entries whose term maxima are kept together.
BLOCK = 16
THRESHOLD = 0.5
OVERLAP = 0.5
SHORT = 8
#: Bytes of item texts in one index block, about.
INDEX_BYTES = 8 << 20
_K1, _B = 1.2, 0.75
_FLAT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks separate."""
    return text.lower().encode().translate(_FLAT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is what follows the last question mark, else the last sentence, else the last third."""
    head, mark, tail = text.rpartition("?")
    question, answer = tokens(head), tokens(tail)
    if not (mark and question and answer):
        parts = [p for p in map(tokens, re.split(r"[.!?\n]+", text)) if p]
        if len(parts) > 1:
            question, answer = [w for p in parts[:-1] for w in p], parts[-1]
        else:
            words = tokens(text)
            cut = len(words) - max(1, len(words) // 3)
            question, answer = words[:cut], words[cut:]
    return question, answer


def _grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(n))))


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's word trigrams (shorter parts: of its own length) that the passage holds."""
    if not part:
        return 1.0
    n = min(3, len(part))
    own = _grams(part, n)
    return len(own & _grams(passage, n)) / len(own)


@dataclass(frozen=True)
class Item:
    item_id: int | None
    question: list[bytes]
    answer: list[bytes]

    @property
    def words(self) -> list[bytes]:
        return self.question + self.answer


class Index:
    """BM25 postings of one block of items, with block maxima."""

    def __init__(self, rows: list[tuple[int | None, str]], frequency: dict[bytes, int], total: int, threshold: float = THRESHOLD, mean: float | None = None) -> None:
        self.items = [Item(i, *question_and_answer(t)) for i, t in rows]
        self.threshold = threshold
        entries: list[tuple[int, list[bytes]]] = []
        for n, (_, t) in enumerate(rows):
            words = tokens(t)
            pieces = max(1, -(-len(words) // ENTRY))
            cuts = [len(words) * k // pieces for k in range(pieces + 1)]
            entries += [(n, words[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        self.owner = [n for n, _ in entries]
        # The mean of all entries where this is one index of several, so that no score depends on the cutting.
        mean = mean or sum(len(w) for _, w in entries) / max(1, len(entries))
        self.impact: list[dict[bytes, float]] = []
        for _, words in entries:
            length = _K1 * (1 - _B + _B * len(words) / mean)
            raw = {}
            for t in set(words):
                n, df = words.count(t), frequency.get(t, 1)
                raw[t] = math.log(1 + (total - df + 0.5) / (df + 0.5)) * n * (_K1 + 1) / (n + length)
            whole = sum(raw.values())
            self.impact.append({t: v / whole for t, v in raw.items()})
        holders: dict[bytes, list[int]] = {}
        for e, own in enumerate(self.impact):
            for t in own:
                holders.setdefault(t, []).append(e)
        rest = np.zeros(len(entries))
        essential = set(holders)
        for t in sorted(holders, key=lambda t: (-len(holders[t]), t)):
            more = rest.copy()
            for e in holders[t]:
                more[e] += self.impact[e][t]
            if more.max() > 0.6 * threshold:
                break
            rest = more
            essential.discard(t)
        self.ids = {t: k for k, t in enumerate(sorted(essential))}
        self.blocks = -(-len(entries) // BLOCK)
        needed = np.full(self.blocks, np.inf)
        np.minimum.at(needed, np.arange(len(entries)) // BLOCK, threshold - rest)
        self.needed = needed - 1e-9
        starts, where, maxima = [0], [], []
        for t in sorted(essential):
            best: dict[int, float] = {}
            for e in holders[t]:
                best[e // BLOCK] = max(best.get(e // BLOCK, 0.0), self.impact[e][t])
            where += best.keys()
            maxima += best.values()
            starts.append(len(where))
        self.starts, self.where, self.maxima = np.array(starts), np.array(where, np.int64), np.array(maxima)
        self.rest = rest
        self.entry_starts = np.concatenate([[0], np.cumsum([len(holders[t]) for t in sorted(essential)])]).astype(np.int64)
        self.entries = np.array([e for t in sorted(essential) for e in holders[t]], np.int64)
        self.weights = np.array([self.impact[e][t] for t in sorted(essential) for e in holders[t]])

    @staticmethod
    def _expand(starts: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of the terms, and how many each term has."""
        sizes = starts[term + 1] - starts[term]
        return np.repeat(starts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the passage), best for each pair."""
        words = [tokens(t) for t in texts]
        if not self.ids:
            return []
        counts = np.fromiter(map(len, words), np.int64, len(words))
        get = self.ids.get
        ids = np.fromiter((k for ws in words for k in map(get, ws, repeat(-1))), np.int64, int(counts.sum()))
        # Halves of a text are numbered on end, with one number left free before the next text.
        halves = -(-counts // ENTRY) + 1
        first_half = np.concatenate([[1], 1 + np.cumsum(halves)])
        first_word = np.concatenate([[0], np.cumsum(counts)])
        at = np.flatnonzero(ids >= 0)
        text = np.searchsorted(first_word, at, side="right") - 1
        half = first_half[text] + (at - first_word[text]) // ENTRY
        # Passage p holds the halves p and p + 1; a term counts once in a passage.
        keys = np.unique(np.concatenate([half, half - 1]) * len(self.ids) + np.concatenate([ids[at], ids[at]]))
        passage, term = keys // len(self.ids), keys % len(self.ids)
        if not len(term):
            return []
        spots, sizes = self._expand(self.starts, term)
        pairs, inverse = np.unique(np.repeat(passage, sizes) * self.blocks + self.where[spots], return_inverse=True)
        bound = np.bincount(inverse, weights=self.maxima[spots])
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        held: tuple[int, list[bytes], set[bytes]] = (-1, [], set())
        alive = pairs[bound >= self.needed[pairs % self.blocks]]
        if not len(alive):
            return []
        # The entries of the blocks left: essential terms first, then in full.
        among = np.isin(passage, alive // self.blocks)
        passage, term = passage[among], term[among]
        spots, sizes = self._expand(self.entry_starts, term)
        passage, entry = np.repeat(passage, sizes), self.entries[spots]
        wanted = passage * self.blocks + entry // BLOCK
        near = alive[np.minimum(np.searchsorted(alive, wanted), len(alive) - 1)] == wanted
        hits, inverse = np.unique(passage[near] * len(self.impact) + entry[near], return_inverse=True)
        partial = np.bincount(inverse, weights=self.weights[spots][near])
        for hit in hits[partial + self.rest[hits % len(self.impact)] >= self.threshold - 1e-9]:
            p, e = divmod(int(hit), len(self.impact))
            t = int(np.searchsorted(first_half, p + 1, side="right")) - 1
            start = (p - int(first_half[t])) * ENTRY
            if held[0] != p:
                inside = words[t][max(0, start) : max(0, start + 2 * ENTRY)]
                held = (p, inside, set(inside))
            score = sum(v for w, v in self.impact[e].items() if w in held[2])
            n = self.owner[e]
            if score < self.threshold or (t, n) in best and best[t, n][0] >= score:
                continue
            item = self.items[n]
            size = len(item.words)
            around = words[t][max(0, start - size) : start + 2 * ENTRY + size]
            asked, answered = overlap(item.question, around), overlap(item.answer, around)
            if self.verified(item, asked, answered, around):
                best[t, n] = (score, asked, answered, max(0, start))
        return [(t, n, *found) for (t, n), found in sorted(best.items())]

    def verified(self, item: Item, asked: float, answered: float, around: list[bytes]) -> bool:
        size = len(item.words)
        if size < SHORT:
            return any(around[i : i + size] == item.words for i in range(len(around) - size + 1))
        both = (asked * len(item.question) + answered * len(item.answer)) / size
        return asked >= OVERLAP and (answered >= OVERLAP or both >= 0.8)


def indexes(items: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes that together hold all items, each of about INDEX_BYTES of text."""
    size, total = items.agg(F.sum(F.octet_length(f"`{text}`")), F.count(F.col(f"`{text}`"))).first()
    if not size:
        return
    sizes = map_texts(items, [], text, lambda ts: {"n": np.array([len(tokens(t)) for t in ts], np.int64)}, "n long")
    entries = F.greatest(F.lit(1), F.ceil(F.col("n") / ENTRY))
    mean = sizes.where("n > 0").agg(F.sum("n") / F.sum(entries)).first()[0]
    words = map_texts(items, [], text, lambda ts: {"words": [sorted(set(tokens(t))) for t in ts]}, "words array<binary>")
    frequency = words.select(F.explode("words").alias("word")).groupBy("word").count()
    blocks = -(-size // INDEX_BYTES)
    dealt = items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL").withColumn(
        "block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for block in range(blocks):
        rows = [(r["i"], r["t"]) for r in dealt.filter(F.col("block") == block).orderBy("i", "t").collect()]
        own = map_texts(dealt.filter(F.col("block") == block), [], "t", lambda ts: {"words": [sorted(set(tokens(t))) for t in ts]}, "words array<binary>")
        known = frequency.join(own.select(F.explode("words").alias("word")).distinct(), "word", "left_semi") if blocks > 1 else frequency
        yield Index(rows, {bytes(r["word"]): r["count"] for r in known.collect()}, total, mean=mean)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and item found in it: key, item, score, question_overlap, answer_overlap, first_word.

    If both ids have one name, the item's is written with `benchmark_` before it. Where there are several indexes,
    what each finds is staged, so only one is held at a time.
    """
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    key_type, item_type = source.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    item_arrow, item_name = to_arrow_type(items.schema[item].dataType), f"benchmark_{item}" if item == key else item
    schema = f"`{key}` {key_type}, `{item_name}` {item_type}, score double, question_overlap double, answer_overlap double, first_word long"
    names = [key, item_name, "score", "question_overlap", "answer_overlap", "first_word"]
    out = None
    for index in indexes(items, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, text):
                    found = index.search(texts_of(part, text))
                    if found:
                        t, n, score, asked, answered, first = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(key).take(pa.array(t)), pa.array([index.items[k].item_id for k in n], item_arrow),
                                pa.array(score), pa.array(asked), pa.array(answered), pa.array(first, pa.int64()),
                            ],
                            names=names)

        found = in_arrow(source, run, schema)
        if out is None:
            out, several = found, False
        else:
            if not several:
                out, several = stage(out, "leaks")[0], True
            out = out.unionByName(stage(found, "leaks")[0])
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs."""
    for index in indexes(items, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[[t for t, *_ in index.search(texts_of(part, text))]] = False
                    yield part.filter(pa.array(clean))

        docs = in_arrow(docs, run, docs.schema)
    return docs

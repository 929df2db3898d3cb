"""Unicode normal forms and fact spans; the parts Spark has no built-in for."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import collapse, words

SPANS = T.ArrayType(
    T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())])
)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def comparable(col: Column) -> Column:
    """NFKC with single spaces."""
    return collapse(nfkc(F.coalesce(col, F.lit(""))))


def comparable_words(col: Column) -> Column:
    return words(nfkc(F.coalesce(col, F.lit(""))))


class _Fold(dict):
    """Folded form of a character; worked out once for each character met."""

    def __init__(self, form: Callable[[str], str]) -> None:
        self.form = form

    def __missing__(self, code: int) -> str:
        self[code] = self.form(chr(code))
        return self[code]


#: compatible: compatibility form, case-folded; lower: SQL's lower(), one character for each.
FOLDS = {
    "compatible": _Fold(lambda c: unicodedata.normalize("NFKC", c).casefold()),
    "lower": _Fold(lambda c: c.lower()[0]),
}


def fold_words(text: str, fold: str = "compatible") -> list[str]:
    """Words of a text after folding each character; two facts are equal if their words are."""
    return text.translate(FOLDS[fold]).split()


def fold_fact(text: Column, fold: str = "compatible") -> Column:
    @F.pandas_udf(T.StringType())
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(fold_words(v, fold)))

    return folded(text)


class FoldedText:
    """An answer in folded form: its words by single spaces, and where each character came from."""

    def __init__(self, text: str, fold: str = "compatible") -> None:
        forms = FOLDS[fold]
        widths = np.fromiter((len(forms[ord(c)]) for c in text), np.int64, len(text))
        source = np.repeat(np.arange(len(text)), widths)
        whole = text.translate(forms)
        found = [m.span() for m in re.finditer(r"\S+", whole)]
        self.text = " ".join(whole[a:b] for a, b in found)
        # A space belongs to the word behind it; no fact starts or ends with one.
        pieces = [source[a - (k > 0) : b] for k, (a, b) in enumerate(found)]
        self.source = np.concatenate(pieces) if pieces else source[:0]

    def spans(self, fact: str) -> list[dict[str, int]]:
        """Places of a folded fact, left to right without overlap, as positions in the original answer."""
        out, at = [], self.text.find(fact) if fact else -1
        while at >= 0:
            stop = at + len(fact)
            out.append({"span_start": int(self.source[at]), "span_end": int(self.source[stop - 1]) + 1})
            at = self.text.find(fact, stop)
        return out


def fact_spans(answer: Column | str, fact: Column | str, fold: str = "compatible") -> Column:
    """Where folded facts occur in answers; an answer with several facts is folded once in a batch."""

    @F.pandas_udf(SPANS)
    def spans(answers: pd.Series, facts: pd.Series) -> pd.Series:
        folded = {text: FoldedText(text, fold) for text in answers.dropna().unique()}
        return pd.Series([[] if text is None or not wanted else folded[text].spans(wanted) for text, wanted in zip(answers, facts)])

    return spans(answer, fact)


@F.pandas_udf(T.LongType())
def ordered_pairs(values: pd.Series) -> pd.Series:
    """Pairs i < j with values[i] < values[j], counted by divide and conquer."""

    def count(a: np.ndarray) -> int:
        if len(a) <= 32:
            return int(np.triu(a[:, None] < a[None, :], 1).sum())
        left, right = a[: len(a) // 2], a[len(a) // 2:]
        return count(left) + count(right) + int(np.searchsorted(np.sort(left), right, side="left").sum())

    return pd.Series([count(np.asarray(v)) for v in values])


@F.pandas_udf(T.LongType())
def pairs_of_blocks(cells: pd.Series) -> pd.Series:
    """Pairs of members of cells (row, column, n), ascending, of which one lies above and to the left of the other.

    One row of cells at a time, against the column sums of the rows above.
    """

    def count(own: list[dict]) -> int:
        at = np.array([(c["p"], c["q"], c["n"]) for c in own], np.int64).reshape(-1, 3)
        columns, q = np.unique(at[:, 1], return_inverse=True)
        above, total = np.zeros(len(columns) + 1, np.int64), 0
        for first, stop in zip(edges := np.flatnonzero(np.diff(at[:, 0], prepend=-1)), [*edges[1:], len(at)]):
            left = np.append(0, np.cumsum(above[1:]))
            total += int((at[first:stop, 2] * left[q[first:stop]]).sum())
            above[q[first:stop] + 1] += at[first:stop, 2]
        return total

    return pd.Series([count(list(own)) for own in cells])


#: Words at more places than this keep their mask; masks of others are made as they are met.
_MANY = 64


def _mask(places: list[int]) -> int:
    found = 0
    for p in places:
        found |= 1 << p
    return found


def edit_distance(left: list[str], right: list[str]) -> int:
    """Levenshtein distance over words; a column of the table is two whole numbers, one bit for each of its cells.

    The bits tell where a cell is one more or one less than the cell above it. Common beginnings and ends are
    left out first; only the longer side's words are kept in masks, so memory stays far below a table.
    """
    start, stop = 0, 0
    shorter = min(len(left), len(right))
    while start < shorter and left[start] == right[start]:
        start += 1
    while stop < shorter - start and left[-1 - stop] == right[-1 - stop]:
        stop += 1
    a, b = sorted((left[start : len(left) - stop], right[start : len(right) - stop]), key=len)
    if not a:
        return len(b)
    places: dict[str, list[int]] = {}
    for i, word in enumerate(b):
        places.setdefault(word, []).append(i)
    masks = {w: _mask(p) for w, p in places.items() if len(p) > _MANY}
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    more, less, distance = full, 0, len(b)
    for word in a:
        same = masks.get(word)
        if same is None:
            same = _mask(places.get(word, ()))
        across = ((same & more) + more ^ more) | same
        up = less | full & ~(across | more)
        down = more & across
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        kept = same | less
        more = (down | ~(kept | up)) & full
        less = up & kept & full
    return distance


@F.pandas_udf(T.LongType())
def word_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edits between two word lists of any size."""
    return pd.Series([edit_distance(list(a), list(b)) for a, b in zip(left, right)])

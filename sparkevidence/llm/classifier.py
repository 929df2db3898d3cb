"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of whole texts are computed in one pass and staged without the texts. Each class's moments
(count, sums, products) are summed inside tasks and then by a grouped aggregate, so only two small
matrices reach the driver, whatever the number of labels. Class covariances are shrunk to the pooled one
and to its diagonal; their Cholesky factors are computed once and serve every score, which is the
logistic of the difference of Mahalanobis log densities plus the log prior odds.

The score depends on the text alone; labels, ids, language and source are never inputs.

Defined cases: null and empty texts have statistics of zero words and get a score like any text; label
rows without a document, or with a null label, teach nothing; repeated label rows count as often as they
stand; if a class has no label, the score is 0.5 everywhere (no labels at all) or the prior of the class
seen; null ids pass through and are held out of learning; an empty table gives an empty result; only id
and text of the documents, id and label of the labels are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_texts, stage, steps, texts_of, WORD
from .quality_rules import repetition

_words = re.compile(WORD).findall
#: Names of the statistics, in order.
FEATURES = (
    "words", "word_length", "symbols", "exclamations", "digits", "capitals", "shouted", "bars", "marks", "lines",
    "dup_lines", "dup_3", "dup_10", "distinct", "top_word", "sentence_length", "odd_ends",
)
#: Shrinkage to the pooled covariance and of that to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.2
#: Largest log odds; densities of outliers differ by more than a probability can tell.
MOST = 30.0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Square root of a share: spreads small shares, keeps zero at zero."""
    return np.sqrt(np.clip(part / np.maximum(1, whole), 0, None))


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics for each text."""
    r = repetition(texts)
    words, chars = r["n_words"].astype(float), r["word_chars"].astype(float)
    byte = np.zeros((len(texts), 256))
    other = np.zeros((len(texts), 5))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        byte[i] = np.bincount(raw, minlength=256)
        tokens = _words(t)
        if tokens:
            counts: dict[str, int] = {}
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
            other[i] = (
                sum(map(str.isupper, tokens)), len(counts), max(counts.values()),
                t.count(". ") + t.count(".\n") + t.count("! ") + t.count("? ") + 1, sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in tokens))
    at = lambda marks: byte[:, [ord(c) for c in marks]].sum(axis=1)
    digits, capitals = byte[:, 48:58].sum(axis=1), byte[:, 65:91].sum(axis=1)
    return np.column_stack([
        np.log1p(words), np.log1p(chars / np.maximum(1, words)), _share(r["n_symbols"], words), _share(at("!"), words), _share(digits, chars),
        _share(capitals, chars), _share(other[:, 0], words), _share(at("|"), words), _share(at(".,;:"), words), np.log1p(r["n_lines"]),
        _share(r["n_dup_lines"], r["n_lines"]), _share(r["n_repeat_words"], words), _share(r["dup_chars_10"], chars),
        np.log1p(other[:, 1]) / np.maximum(1, np.log1p(words)), _share(other[:, 2], words), np.log1p(words / np.maximum(1, other[:, 3])),
        _share(other[:, 4], words),
    ])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log prior odds."""

    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        density = np.empty((2, len(x)))
        for k in range(2):
            whitened = (x - self.means[k]) @ self.inverses[k].T
            density[k] = -0.5 * (np.einsum("ij,ij->i", whitened, whitened) + self.log_dets[k])
        odds = np.clip(density[1] - density[0] + self.log_odds, -MOST, MOST)
        return 1 / (1 + np.exp(-odds))


def fit(moments: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """Model from moments[label] = sum of outer products of (1, statistics)."""
    size = moments.shape[1] - 1
    counts = moments[:, 0, 0]
    if counts.min() == 0:
        odds = 0.0 if counts.max() == 0 else float(np.log(counts[1] + 1) - np.log(counts[0] + 1))
        return Model(np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2), odds)
    means = moments[:, 0, 1:] / counts[:, None]
    scatter = moments[:, 1:, 1:] - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / counts.sum()
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(size)
    inverses, log_dets = [], []
    for k in range(2):
        weight = max(to_pooled, size / (counts[k] + size))
        factor = np.linalg.cholesky((1 - weight) * scatter[k] / counts[k] + weight * pooled)
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(means, np.array(inverses), np.array(log_dets), float(np.log(counts[1] / counts[0])))


def class_moments(features: DataFrame, labels: DataFrame, key: str, label: str) -> np.ndarray:
    """Moments of both classes over all labelled rows of features (key, x)."""
    width = len(FEATURES) + 1
    rows = features.join(labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("label")), F.col(key) == F.col("__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), np.array(batch.column("x").to_pylist(), float).reshape(-1, width - 1)])
            y = np.array(batch.column("label").to_pylist())
            for k in range(2):
                sums[k] += x[y == k].T @ x[y == k]
        at = np.indices(sums.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in at), pa.array(sums.reshape(-1))], names=["k", "i", "j", "v"])

    cells = in_arrow(rows.filter("label IN (0, 1)").select("x", "label"), run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((2, width, width))
    for r in cells.collect():
        out[r["k"], r["i"], r["j"]] = r["v"]
    return out


def remainder(key: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(by))


def featurize(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return map_texts(docs, keep, text, lambda ts: {"x": list(statistics(ts))}, "x array<double>")


def train(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", held_out: Column | None = None) -> Model:
    """Model from all labelled rows that are not held out."""
    held_out = F.coalesce(remainder(key, 3) == 1, F.lit(True)) if held_out is None else held_out
    return fit(class_moments(features.filter(~held_out), labels, key, label))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted of every row of docs."""
    features, _ = stage(featurize(docs, [key], text), "features")
    model = train(features, labels, key, label)
    held = F.coalesce(remainder(key, 3) == 1, F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    kind = features.schema[key].dataType.simpleString()
    return in_arrow(features.select(key, held.alias("held_out"), "x"), run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `least`, with the columns of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                yield part.filter(pa.array(model.score(statistics(texts_of(part, text))) >= least))

    return in_arrow(docs, run, docs.schema)

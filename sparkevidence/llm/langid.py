"""Language identification by Bayesian evidence fusion.

Evidence of a page, all turned into log probabilities for each language and added:
- its main text: hashed byte trigrams under a multinomial model of each language, counted over all
  labelled documents inside the tasks and then by a grouped sum (languages x `BINS` numbers in all);
  trigrams of a text depend on each other, so n of them weigh as n ** `TRUST`;
- the language declared in its markup and the suffix of its address: how often each goes with each
  language in the corpus, smoothed by its overall frequency;
- its host: language counts of the host, smoothed by those of its domain, those by the whole corpus.
The counts come from the text evidence of all pages by grouped aggregates (combined before the shuffle),
and a page's own vote is taken out again before it is judged. Documents take part with their source as
the host and neither markup nor address.

Defined cases: a text too short for a trigram casts no vote and is judged by the other evidence; null
markup, address or source add nothing; ties go to the language first in order; repeated rows vote each;
null ids pass through; without labelled documents the language is null; an empty table gives an empty
result; long texts are counted whole; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stage, steps, texts_of
from .html import Page

BINS = 1 << 13
TRUST = 0.6
#: Votes that the wider level of a prior counts for.
STRENGTH = 5.0
#: Keys over which the rows of one host, domain, suffix or declared language are spread.
SALTS = 32
_declared = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, white space folded and letters lower-cased."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(BINS, np.int64)
    mixed = (raw[:-2] * 0x9E3779B1 + raw[1:-1] * 0x85EBCA77 + raw[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    return np.bincount((mixed >> 15) % BINS, minlength=BINS)


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bin for each of them, from all labelled documents."""
    source = docs.select(F.col(f"`{text}`").alias("text"), F.lower(F.col(f"`{lang}`")).alias("lang")).filter("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                for own, t in zip(part.column("lang").to_pylist(), texts_of(part, "text")):
                    sums.setdefault(own, np.zeros(BINS, np.int64))
                    sums[own] += trigrams(t)
        for own, values in sums.items():
            at = np.flatnonzero(values)
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(at)), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["lang", "bin", "n"])

    rows = in_arrow(source, count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), BINS), 0.5)
    place = {own: k for k, own in enumerate(langs)}
    for r in rows:
        counts[place[r["lang"]], r["bin"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _scored(source: DataFrame, langs: list[str], model: np.ndarray, pages: bool) -> DataFrame:
    """Adds declared, text_lang (place of the best language) and scores to (doc_id, page_id, url, host, domain, suffix, raw)."""
    keep = ["doc_id", "page_id", "url", "host", "domain", "suffix"]
    types = {c: source.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "raw"):
                declared, best, scores = [], [], []
                for raw in texts_of(part, "raw"):
                    found = _declared.search(raw) if pages else None
                    declared.append(found[1].lower() if found else None)
                    counts = trigrams(Page(raw).text(None) if pages else raw)
                    n = counts.sum()
                    own = model @ counts * (float(n) ** TRUST / n) if n and langs else np.zeros(len(langs))
                    best.append(int(own.argmax()) if n and langs else None)
                    scores.append((own - own.max()).tolist() if langs else [])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(declared, pa.string()), pa.array(best, pa.int32()), pa.array(scores, pa.list_(pa.float64()))],
                    names=[*keep, "declared", "text_lang", "scores"])

    return in_arrow(source, run, ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "declared string, text_lang int, scores array<double>"]))


def page_source(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with the parts of their addresses. The domain is the host's last two labels but one, with its suffix."""
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host.alias("host"),
        F.substring_index(host, ".", -3).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), F.col(f"`{html}`").alias("raw"))


def document_source(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("source:"), F.col(f"`{source}`")).alias("host"), F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"), F.col(f"`{text}`").alias("raw"))


def _votes(staged: DataFrame, by: str, size: int) -> DataFrame:
    """Votes of each language for each value of a column, as an array, once for each salt."""
    sums = [F.count(F.when(F.col("text_lang") == k, 1)) for k in range(size)]
    counted = staged.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"_{by}")).agg(F.array(*sums).alias(f"{by}_votes"))
    return counted.withColumn(f"_{by}_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, url, lang, probability, text_lang and declared of every document and page."""
    langs, model = text_model(docs)
    both = _scored(page_source(pages), langs, model, True).unionByName(_scored(document_source(docs), langs, model, False))
    staged, _ = stage(both, "evidence")
    size = len(langs)
    if not size:
        none = F.lit(None).cast("string")
        return staged.select("doc_id", "page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared")
    overall = staged.agg(*[F.count(F.when(F.col("text_lang") == k, 1)) for k in range(size)]).first()
    total = max(1, sum(overall))
    # A quarter vote for each language keeps every prior above zero.
    prior = [(n + 0.25) / (total + 0.25 * size) for n in overall]
    # A host or suffix of a third of all rows meets its votes under many salts.
    salted = staged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "page_id"), F.lit(SALTS)).cast("int"))
    rows = reduce(
        lambda df, by: df.join(_votes(staged, by, size), (F.col(by) == F.col(f"_{by}")) & (F.col("salt") == F.col(f"_{by}_salt")), "left"),
        ["host", "domain", "suffix", "declared"], salted)

    def own(k: int, by: str) -> Column:
        """Votes for language k of this row's value, without the row's own."""
        return F.coalesce(F.get(f"{by}_votes", F.lit(k)), F.lit(0)) - F.when(F.col(by).isNotNull() & (F.col("text_lang") == k), 1).otherwise(0)

    def number(by: str) -> Column:
        return reduce(lambda a, b: a + b, [own(k, by) for k in range(size)])

    def one(k: int) -> Column:
        wide = (own(k, "domain") + STRENGTH * prior[k]) / (number("domain") + STRENGTH)
        logs = F.get("scores", F.lit(k)) + F.log((own(k, "host") + STRENGTH * wide) / (number("host") + STRENGTH))
        for by in ("suffix", "declared"):
            usual = (number(by) + 1) / (total + 1)
            logs = logs + F.when(F.col(by).isNotNull(), F.log((own(k, by) + STRENGTH * usual) / (overall[k] + STRENGTH))).otherwise(0.0)
        return logs

    fused = rows.withColumn("logs", F.array(*[one(k) for k in range(size)])).withColumn("top", F.array_max("logs"))
    names = F.array(*map(F.lit, langs))
    return fused.select(
        "doc_id", "page_id", "url", F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1).alias("lang"),
        (1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)).alias("probability"),
        F.get(names, F.col("text_lang")).alias("text_lang"), "declared")

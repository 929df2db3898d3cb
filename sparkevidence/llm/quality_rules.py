"""Quality rules: how much of a text stands inside repeated word n-grams and repeated lines.

Every text is handled inside its row, so nothing is shuffled and no group can be hot. A word's hash is
taken once; hashes of all n-gram lengths come from one prefix sum of hash times power (a rolling hash
modulo 2^64), and equal n-grams of a text are found by one sort for each length over a block of texts.

Defined cases: a null text has no words and fails the base; an empty or blank text likewise; rows are
independent, so repeated rows give repeated results; an empty table gives an empty result; the id may be
null and is passed through; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import in_arrow, map_texts, SPACES, WORD

#: Lengths of the n-grams; 3 also serves the base count of repeated words.
LENGTHS = (3, 5, 7, 10)
_words = re.compile(WORD).findall
_symbols = re.compile(r"[#*$%&|<>]").findall
#: Odd base of the rolling hash and its inverse modulo 2^64; an odd factor keeps texts of a block apart.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_APART = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rules:
    """Limits in percent. Chars and lines are shares of the characters in words and of the lines with a word."""

    min_words: int = 50
    repeat_words: int = 50
    symbols_per_word: int = 30
    dup_chars: tuple[tuple[int, int], ...] = ((5, 40), (7, 35), (10, 30))
    dup_lines: int = 40
    dup_line_chars: int = 35


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def repetition(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of one block of texts, as arrays with one entry for each text."""
    count = len(texts)
    words = [_words(t) for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, count)
    ends = np.cumsum(n_words)
    total = int(ends[-1]) if count else 0
    hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    sizes = np.fromiter((len(w) for ws in words for w in ws), np.int64, total)
    owner = np.repeat(np.arange(count, dtype=np.int64), n_words)
    last = ends[owner] if total else ends[:0]
    place = np.arange(total, dtype=np.int64)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=count).astype(np.int64) if total else np.zeros(count, np.int64)

    out = {"n_words": n_words, "word_chars": per_text(sizes)}
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, total))])
    back = _powers(_INVERSE, total)
    for n in LENGTHS:
        starts = place[place + n <= last]
        grams = (sums[starts + n] - sums[starts]) * back[starts] + owner[starts].astype(np.uint64) * _APART
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(total + 1, np.int64)
        np.add.at(edges, starts[twice], 1)
        np.add.at(edges, starts[twice] + n, -1)
        covered = np.cumsum(edges)[:total] > 0
        out[f"dup_chars_{n}"] = per_text(sizes * covered)
        if n == 3:
            out["n_repeat_words"] = per_text(covered)
    lines = np.zeros((4, count), np.int64)
    for i, t in enumerate(texts):
        seen: set[str] = set()
        for line in t.split("\n"):
            if width := len(line.strip(SPACES)):
                lines[0, i] += 1
                lines[2, i] += width
                if line in seen:
                    lines[1, i] += 1
                    lines[3, i] += width
                seen.add(line)
    out |= {"n_lines": lines[0], "n_dup_lines": lines[1], "line_chars": lines[2], "dup_line_chars": lines[3]}
    out["n_symbols"] = np.fromiter((len(_symbols(t)) for t in texts), np.int64, count)
    return out


def judge(stats: dict[str, np.ndarray], rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts; whole-number comparisons only."""
    words, chars = stats["n_words"], stats["word_chars"]
    failed = (words < rules.min_words) | (100 * stats["n_repeat_words"] > rules.repeat_words * words)
    bad = 100 * stats["n_symbols"] > rules.symbols_per_word * words
    for n, most in rules.dup_chars:
        bad |= 100 * stats[f"dup_chars_{n}"] > most * chars
    bad |= 100 * stats["n_dup_lines"] > rules.dup_lines * stats["n_lines"]
    bad |= 100 * stats["dup_line_chars"] > rules.dup_line_chars * stats["line_chars"]
    return failed, ~failed & ~bad


COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars",
    *(f"dup_chars_{n}" for n in LENGTHS),
)


def score_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts, base_failed and kept for every row of docs."""

    def run(texts: list[str]) -> dict[str, np.ndarray]:
        stats = repetition(texts)
        stats["base_failed"], stats["kept"] = judge(stats, rules)
        return stats

    fields = ", ".join([*(f"{c} long" for c in COLUMNS), "base_failed boolean", "kept boolean"])
    return map_texts(docs, list(keep), text, run, fields)


def filter_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""

    def run(batches):
        from .common import steps, texts_of

        for batch in batches:
            for part in steps(batch, text):
                _, kept = judge(repetition(texts_of(part, text)), rules)
                yield part.filter(kept)

    return in_arrow(docs, run, docs.schema)


def rules_sql(table: str = "documents", rules: Rules = Rules()) -> str:
    """The same result in DuckDB SQL, n-grams as word lists."""
    grams = " UNION ALL ".join(
        f"SELECT r, {n} AS n, i, list_slice(ws, i, i + {n - 1}) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d)"
        for n in LENGTHS
    )
    covered = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in LENGTHS)
    limits = " OR ".join(f"100 * dup_chars_{n} > {most} * word_chars" for n, most in rules.dup_chars)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM {table}),
grams AS ({grams}),
twice AS (SELECT r, n, i FROM (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS c FROM grams) WHERE c > 1),
words AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM twice),
cover AS (SELECT r, n, count(*) AS words, sum(length(d.ws[words.i])) AS chars FROM words JOIN d USING (r) GROUP BY r, n),
dup AS (SELECT r, coalesce(max(words) FILTER (n = 3), 0)::BIGINT AS n_repeat_words, {covered} FROM cover GROUP BY r),
ls AS (
  SELECT r, line, length(trim(line, E' \t\n\x0b\x0c\r')) AS width,
         row_number() OVER (PARTITION BY r, line) AS nth
  FROM (SELECT r, unnest(string_split(t, E'\n')) AS line FROM d)),
lines AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (nth > 1)::BIGINT AS n_dup_lines,
         sum(width)::BIGINT AS line_chars, coalesce(sum(width) FILTER (nth > 1), 0)::BIGINT AS dup_line_chars
  FROM ls WHERE width > 0 GROUP BY r),
stats AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in (*COLUMNS[3:], ))}
  FROM d LEFT JOIN dup USING (r) LEFT JOIN lines USING (r)),
base AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_words} * n_words AS base_failed FROM stats)
SELECT *, NOT base_failed AND NOT (
    100 * n_symbols > {rules.symbols_per_word} * n_words OR {limits}
    OR 100 * n_dup_lines > {rules.dup_lines} * n_lines
    OR 100 * dup_line_chars > {rules.dup_line_chars} * line_chars) AS kept
FROM base"""

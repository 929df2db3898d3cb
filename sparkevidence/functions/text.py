"""Text functions as Column expressions (JVM side, no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and words that decide results.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
TERM = "[a-z0-9]+"
CONTENT_TOKEN = "[a-z0-9]{2,}"
SENTENCE_END = "[.!?]+"
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "are", "was")
CJK = "[\\u4e00-\\u9fff]"
LATIN = "[A-Za-z]"
SECRET = (
    r"(?i)(canary|password|passwd|secret|credential|api[-_ ]?key|authorization|bearer"
    r"|\btoken\b|deepseek|provider\s*(?:request|response|payload)|raw\s*payload"
    r"|(?:sk|pk|rk)-[A-Za-z0-9_-]{8,}|[A-Za-z0-9+/=_-]{32,})"
)


def words(col: Column) -> Column:
    """Whitespace-separated words; Unicode spaces count, empty pieces do not."""
    return F.filter(F.split(col, WHITESPACE), lambda w: w != "")


def token_count(col: Column) -> Column:
    return F.size(words(F.coalesce(col, F.lit(""))))


def collapse(col: Column) -> Column:
    return F.array_join(words(col), " ")


def terms(col: Column) -> Column:
    """Index terms: lower-cased ASCII letter and digit runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TERM), F.lit(0))


def content_tokens(col: Column) -> Column:
    """Distinct terms of two or more characters that are not stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(CONTENT_TOKEN), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def sentences(col: Column) -> Column:
    return F.split(col, SENTENCE_END)


def fold(col: Column) -> Column:
    """Lower case and single spaces, the comparable form of a fact."""
    return F.lower(collapse(col))


def redact(col: Column) -> Column:
    """Text safe to show in run metadata."""
    flat = collapse(col)
    unsafe = flat.rlike(SECRET) | flat.startswith("{") | flat.startswith("[")
    return F.when(unsafe, F.lit("[redacted]")).otherwise(flat)


def excerpt(col: Column, chars: int = 280) -> Column:
    """The first `chars` characters, marked with '...' when something was cut."""
    return F.when(
        F.length(col) > chars, F.concat(F.rtrim(F.substring(col, 1, chars)), F.lit("..."))
    ).otherwise(col)

"""Deterministic identifiers and comparable keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(part: Column | str) -> Column:
    column = F.col(part) if isinstance(part, str) else part
    return F.coalesce(column.cast("string"), F.lit(""))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """`prefix_` plus 32 hex digits of the SHA-256 of the parts; NULL counts as ''."""
    joined = F.concat_ws("|", *[_text(p) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 32))


def locator_key(locator: Column | str) -> Column:
    """JSON of a locator struct; its fields are declared alphabetically and NULLs drop out."""
    return F.to_json(locator)


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[_text(p) for p in parts]), 256)

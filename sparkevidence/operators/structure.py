"""Heading hierarchy, heading paths, visual order, structure counts and language detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import CJK, LATIN
from .scans import BLOCK, blocked_row_number, blocked_scan

LEVELS = range(1, 10)


def _heading_marks(prefix: str, value: Column) -> dict[str, Column]:
    level = F.coalesce(F.col("level"), F.lit(1))
    heading = F.struct(F.col("reading_order").alias("at"), level.alias("level"), value.alias("value"))
    return {
        f"{prefix}{n}": F.when((F.col("kind") == "heading") & (level == n), heading) for n in LEVELS
    }


def path_marks() -> dict[str, Column]:
    return _heading_marks("_h", F.coalesce("text", F.lit("")))


def path_from_marks() -> Column:
    """Texts of the open headings: the last heading of a level is open when no heading of a lower
    level number came after it."""
    entries, later = [], F.lit(-1)
    for n in LEVELS:
        at = F.col(f"_h{n}")["at"]
        entries.append(F.when(at > later, F.col(f"_h{n}")["value"]))
        later = F.greatest(later, at)
    return F.array_compact(F.array(*entries))


def heading_path(elements: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `hierarchy_context`: texts of the open headings, a heading's own text included."""
    seen = blocked_scan(elements, ["document_id"], "reading_order", path_marks(), width=block)
    return seen.withColumn("hierarchy_context", path_from_marks()).drop(*[f"_h{n}" for n in LEVELS])


def _with_parent(elements: DataFrame, block: int) -> DataFrame:
    """Add `_top`: the heading under which each row sits, NULL when none is open."""
    marks = _heading_marks("_h", F.col("id"))
    seen = blocked_scan(
        elements, ["document_id"], "reading_order", marks, include_current=False, width=block
    )
    own = F.when(F.col("kind") == "heading", F.coalesce(F.col("level"), F.lit(1))).otherwise(F.lit(10))
    # The latest heading of a lower level number is always still open.
    top = F.greatest(*[F.when(own > n, F.col(f"_h{n}")) for n in LEVELS])
    return seen.withColumn("_top", top).drop(*[f"_h{n}" for n in LEVELS])


def heading_hierarchy(elements: DataFrame, block: int = BLOCK) -> DataFrame:
    """Fill missing parents with the nearest open heading; documents that skip a level drop out."""
    placed = _with_parent(elements, block)
    bad = placed.filter(_skips()).select("document_id").distinct()
    return (
        placed.join(bad, "document_id", "left_anti")
        .withColumn("parent_id", F.coalesce("parent_id", F.col("_top.value")))
        .drop("_top")
    )


def _skips() -> Column:
    return (F.col("kind") == "heading") & (F.col("level") > F.col("_top.level") + 1)


def hierarchy_rejects(elements: DataFrame, block: int = BLOCK) -> DataFrame:
    return _with_parent(elements, block).filter(_skips()).select("document_id").distinct().select(
        F.lit("document").alias("entity"), F.col("document_id").alias("id"),
        F.lit("heading_level_skip").alias("rule"), F.lit("CANONICAL_DOCUMENT_INVALID").alias("code"),
    )


def layout_order(elements: DataFrame, page_width: int = 1) -> DataFrame:
    """Renumber elements by (page, top, left, old order); only all-pdf documents are accepted.

    A document whose new order would put a child before its parent is rejected.
    """
    other = elements.filter(F.col("locator.kind") != "pdf").select("document_id").distinct()
    pdf = elements.join(other, "document_id", "left_anti")
    ordered = blocked_row_number(
        pdf, ["document_id"], F.floor(F.col("locator.page_number") / page_width),
        [F.col("locator.page_number"), F.col("locator.y0"), F.col("locator.x0"), F.col("reading_order")],
        "_new", 0,
    ).withColumn("reading_order", F.col("_new").cast("int")).drop("_new")
    parents = ordered.select(
        "document_id", F.col("id").alias("parent_id"), F.col("reading_order").alias("_above")
    )
    broken = (
        ordered.select("document_id", "parent_id", "reading_order")
        .join(parents, ["document_id", "parent_id"])
        .filter("_above >= reading_order").select("document_id").distinct()
    )
    return ordered.join(broken, "document_id", "left_anti")


def structure_metrics(elements: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Elements, hierarchy links and tables per document."""
    counts = elements.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.count_if(F.col("parent_id").isNotNull()).alias("hierarchy_links"),
    )
    if tables is None:
        return counts.withColumn("tables", F.lit(0).cast("long"))
    per_table = tables.groupBy("document_id").agg(F.count(F.lit(1)).alias("tables"))
    return counts.join(per_table, "document_id", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))


def detect_languages(elements: DataFrame) -> DataFrame:
    """Declared languages, else `zh`/`en` by script, else `und`; sorted and comma-joined."""
    flags = elements.groupBy("document_id").agg(
        F.collect_set("language").alias("_declared"),
        F.bool_or(F.coalesce(F.col("text").rlike(CJK), F.lit(False))).alias("_zh"),
        F.bool_or(F.coalesce(F.col("text").rlike(LATIN), F.lit(False))).alias("_en"),
    )
    guessed = F.array_compact(F.array(F.when(F.col("_en"), "en"), F.when(F.col("_zh"), "zh")))
    joined = F.array_join(
        F.when(F.size("_declared") > 0, F.array_sort("_declared")).otherwise(guessed), ","
    )
    return flags.select(
        "document_id", F.when(joined == "", F.lit("und")).otherwise(joined).alias("languages")
    )

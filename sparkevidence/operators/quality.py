"""Ingestion metrics: labelled elements, tables and spans against observed output, per document.

Every function returns (document_id, metric_id, status, value, labelled_count, matched_count).
Labels name their target by id in the expected document; observed rows are found by locator key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import locator_key
from ..functions.normal import comparable, comparable_words, ordered_pairs, pairs_of_blocks, word_distance
from ..session import materialize
from .scans import BLOCK, block_of, blocked_row_number

# Metric ids and statuses.
CER = "metric.ingestion.cer@1"
WER = "metric.ingestion.wer@1"
ELEMENT_F1 = "metric.ingestion.element-f1@1"
READING_ORDER = "metric.ingestion.reading-order@1"
TABLE_STRUCTURE = "metric.ingestion.table-structure@1"
TABLE_CELL = "metric.ingestion.table-cell@1"
LOCATOR_ACCURACY = "metric.ingestion.locator-accuracy@1"
EVIDENCE_PRESERVATION = "metric.ingestion.evidence-preservation@1"
VALUE = "VALUE"
NOT_APPLICABLE = "NOT_APPLICABLE"
INSUFFICIENT_LABELS = "INSUFFICIENT_LABELS"


def _report(rows: DataFrame, metric: str, value: Column, labelled: Column, matched: Column,
            status: Column | None = None) -> DataFrame:
    shown = F.lit(VALUE) if status is None else status
    return rows.select(
        "document_id", F.lit(metric).alias("metric_id"), shown.alias("status"),
        F.when(shown == VALUE, value).alias("value"),
        labelled.cast("long").alias("labelled_count"), matched.cast("long").alias("matched_count"),
    )


def _spans(labels: DataFrame, observed: DataFrame) -> DataFrame:
    """Labels (document_id, element_id, start, end, label) with the observed text of their region."""
    texts = observed.select("document_id", F.col("id").alias("element_id"), F.col("text").alias("_text"))
    region = F.substring(F.coalesce("_text", F.lit("")), F.col("start") + 1, F.col("end") - F.col("start"))
    return labels.join(texts, ["document_id", "element_id"], "left").select(
        "document_id", "label", region.alias("_region")
    )


def _error_rate(rows: DataFrame, metric: str) -> DataFrame:
    sums = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_d").alias("d"), F.sum(F.greatest("_len", F.lit(1))).alias("t")
    )
    value = F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("t"))
    return _report(sums, metric, value, F.col("n"), F.when(F.col("d") == 0, F.col("n")).otherwise(0))


def cer(labels: DataFrame, observed: DataFrame) -> DataFrame:
    """Character accuracy: 1 - edits / label characters; `matched` is all labels or none."""
    clean = _spans(labels, observed).select(
        "document_id", comparable(F.col("label")).alias("l"), comparable(F.col("_region")).alias("r")
    )
    return _error_rate(
        clean.select("document_id", F.levenshtein("l", "r").alias("_d"), F.length("l").alias("_len")), CER
    )


def wer(labels: DataFrame, observed: DataFrame) -> DataFrame:
    """Word accuracy, the same over words."""
    clean = _spans(labels, observed).select(
        "document_id", comparable_words(F.col("label")).alias("l"), comparable_words(F.col("_region")).alias("r")
    )
    return _error_rate(
        clean.select("document_id", word_distance(F.col("l"), F.col("r")).alias("_d"), F.size("l").alias("_len")),
        WER,
    )


def _targets(labels: DataFrame, expected: DataFrame) -> DataFrame:
    known = expected.select(
        "document_id", F.col("id").alias("element_id"), locator_key("locator").alias("key"), "kind", "reading_order"
    )
    # A label whose element is unknown has no locator; it is never found but counts.
    return labels.select("document_id", "element_id").join(known, ["document_id", "element_id"], "left")


def element_f1(labels: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """F1 of (locator, kind) pairs; observed pairs count only at labelled locators."""
    targets = _targets(labels, expected)
    wanted = targets.select("document_id", "key", "kind").distinct()
    places = wanted.select("document_id", "key").distinct()
    found = (
        observed.select("document_id", locator_key("locator").alias("key"), "kind")
        .join(places, ["document_id", "key"], "left_semi").distinct()
    )
    both = wanted.withColumn("e", F.lit(1)).join(
        found.withColumn("o", F.lit(1)), ["document_id", "key", "kind"], "full"
    )
    sums = both.groupBy("document_id").agg(
        F.count("e").alias("e"), F.count("o").alias("o"),
        F.count_if(F.col("e").isNotNull() & F.col("o").isNotNull()).alias("m"),
    ).join(labels.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id")
    value = F.when(F.col("e") + F.col("o") > 0, 2 * F.col("m") / (F.col("e") + F.col("o"))).otherwise(0.0)
    return _report(sums, ELEMENT_F1, value, F.col("n"), F.col("m"))


def _agreeing_pairs(placed: DataFrame, block: int) -> DataFrame:
    """(document_id, m): pairs in their expected order of which the observed order agrees.

    Places in expected order are cut into blocks, observed values into ranges. Pairs of one block, pairs of one
    range and different blocks, and pairs of different blocks and ranges, which the sizes of the cells give, are
    counted apart, so no list holds a document.
    """
    key = ["document_id"]
    order = [F.col("reading_order"), F.col("obs")]
    numbered = blocked_row_number(placed.select(*key, "reading_order", "obs"), key, block_of("reading_order", block), order, "at", 0)
    cut = materialize(numbered.select(*key, "at", F.col("obs").cast("long").alias("obs"), block_of("at", block).alias("p"), block_of("obs", block).alias("q")), "reading-order")
    inside = cut.groupBy(*key, "p").agg(F.sort_array(F.collect_list(F.struct("at", "obs"))).alias("x"))
    # Descending within a block: its own pairs do not count again.
    across = cut.groupBy(*key, "q").agg(F.sort_array(F.collect_list(F.struct("p", (-F.col("obs")).alias("back")))).alias("x"))
    cells = cut.groupBy(*key, "p", "q").agg(F.count(F.lit(1)).alias("n"))
    apart = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("p", "q", "n"))).alias("x")).filter(F.size("x") > 1)
    found = [
        inside.select(*key, ordered_pairs(F.transform("x", lambda x: x["obs"])).alias("m")),
        across.select(*key, ordered_pairs(F.transform("x", lambda x: -x["back"])).alias("m")),
        apart.select(*key, pairs_of_blocks("x").alias("m")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy(*key).agg(F.sum("m").alias("m"))


def reading_order(labels: DataFrame, expected: DataFrame, observed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Share of label pairs whose observed order agrees; fewer than two labels are too few."""
    seen = observed.select(
        "document_id", locator_key("locator").alias("key"), "kind", F.col("reading_order").alias("obs")
    ).groupBy("document_id", "key", "kind").agg(F.max("obs").alias("obs"))
    placed = _targets(labels, expected).join(seen, ["document_id", "key", "kind"], "left")
    sizes = placed.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    agreeing = _agreeing_pairs(placed.filter(F.col("obs").isNotNull()), block)
    counted = sizes.join(agreeing, "document_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    status = F.when(F.col("n") < 2, INSUFFICIENT_LABELS).otherwise(VALUE)
    return _report(
        counted, READING_ORDER, F.col("m") / pairs, F.col("n"), F.when(F.col("n") < 2, 0).otherwise(F.col("m")), status
    )


def _geometry(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables with a digest of their ordered cell geometry."""
    shape = F.struct("row", "column", "row_span", "column_span", "is_header")
    shapes = cells.groupBy("document_id", "table_id").agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(shape))), 256).alias("shape")
    )
    return tables.select(
        "document_id", F.col("id").alias("table_id"), locator_key("locator").alias("key"), "rows", "columns"
    ).join(shapes, ["document_id", "table_id"], "left").withColumn("shape", F.coalesce("shape", F.lit("")))


def table_structure(
    labels: DataFrame, expected_tables, expected_cells, observed_tables, observed_cells
) -> DataFrame:
    """Labelled tables with equal rows, columns and cell geometry at the same locator.

    Every label counts, also one of an unknown table or of a table without cells. Of several observed
    tables at a locator the one with the smallest id is compared.
    """
    wanted = labels.join(_geometry(expected_tables, expected_cells), ["document_id", "table_id"], "left")
    shape = ["rows", "columns", "shape"]
    found = _geometry(observed_tables, observed_cells).groupBy("document_id", "key").agg(
        F.min_by(F.struct(*shape), "table_id").alias("_seen")
    )
    hits = wanted.join(found, ["document_id", "key"], "left").withColumn(
        "hit", F.when(F.struct(*shape) == F.col("_seen"), 1)
    )
    sums = hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m"))
    return _report(sums, TABLE_STRUCTURE, F.col("m") / F.col("n"), F.col("n"), F.col("m"))


def table_cell(labels: DataFrame, expected_tables, expected_cells, observed_tables, observed_cells) -> DataFrame:
    """Labelled cells found with the same place, header flag and normalised text."""
    same = ["row", "column", "row_span", "column_span", "is_header", "_text"]

    def keyed(tables: DataFrame, cells: DataFrame) -> DataFrame:
        keys = tables.select("document_id", F.col("id").alias("table_id"), locator_key("locator").alias("key"))
        return cells.withColumn("_text", comparable(F.col("text"))).join(keys, ["document_id", "table_id"], "left")

    wanted = labels.join(
        keyed(expected_tables, expected_cells).withColumnRenamed("id", "cell_id"),
        ["document_id", "table_id", "cell_id"], "left",
    )
    found = keyed(observed_tables, observed_cells).select("document_id", "key", *same).distinct()
    hits = wanted.join(found.withColumn("hit", F.lit(1)), ["document_id", "key", *same], "left")
    sums = hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m"))
    return _report(sums, TABLE_CELL, F.col("m") / F.col("n"), F.col("n"), F.col("m"))


def _share_found(wanted: DataFrame, places: DataFrame, metric: str) -> DataFrame:
    hits = wanted.join(places.distinct().withColumn("hit", F.lit(1)), ["document_id", "key"], "left")
    sums = hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m"))
    return _report(sums, metric, F.col("m") / F.col("n"), F.col("n"), F.col("m"))


def locator_accuracy(labels: DataFrame, observed: DataFrame, observed_tables: DataFrame | None = None) -> DataFrame:
    """Labelled locators (document_id, locator) present among observed elements or tables."""
    places = observed.select("document_id", locator_key("locator").alias("key"))
    if observed_tables is not None:
        places = places.unionByName(observed_tables.select("document_id", locator_key("locator").alias("key")))
    return _share_found(labels.select("document_id", locator_key("locator").alias("key")), places, LOCATOR_ACCURACY)


def evidence_preservation(labels: DataFrame, expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labelled elements whose locator some chunk cites."""
    places = chunks.select("document_id", F.explode("citations").alias("c")).select(
        "document_id", locator_key("c.locator").alias("key")
    )
    return _share_found(_targets(labels, expected).select("document_id", "key"), places, EVIDENCE_PRESERVATION)


def unlabelled(documents: DataFrame, labels: DataFrame, metric: str) -> DataFrame:
    """NOT_APPLICABLE rows for documents without a label of the metric's kind."""
    none = documents.select("document_id").distinct().join(labels.select("document_id"), "document_id", "left_anti")
    zero = F.lit(0)
    return _report(none, metric, F.lit(None).cast("double"), zero, zero, F.lit(NOT_APPLICABLE))

"""Elements from page text, OCR exchange rows, canonical JSON and typed provider rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import locator_key, stable_id
from ..functions.text import words
from ..schemas import CANONICAL, OCR_EXCHANGE, locator

# Fixed value: words per element cut from page text.
PAGE_ELEMENT_WORDS = 480
CANONICAL_VERSION = "CanonicalDocument/v1"


def _page_pieces(pages: Column, size: int) -> Column:
    """array<struct<page, text>> of at most `size` words each, blank pages skipped."""
    tokenised = F.filter(
        F.transform(pages, lambda p, i: F.struct((i + 1).alias("page"), words(p).alias("w"))),
        lambda p: F.size(p["w"]) > 0,
    )
    cut = F.transform(
        tokenised,
        lambda p: F.transform(
            F.sequence(F.lit(0), ((F.size(p["w"]) - 1) / size).cast("int")),
            lambda k: F.struct(
                p["page"].alias("page"),
                F.array_join(F.slice(p["w"], k * size + 1, size), " ").alias("text"),
            ),
        ),
    )
    return F.flatten(cut)


def page_elements(pages: Column, document_id: Column, size: int = PAGE_ELEMENT_WORDS) -> Column:
    """All elements of one document as an array, computed inside its row (no shuffle)."""
    return F.transform(
        _page_pieces(pages, size),
        lambda p, i: F.struct(
            stable_id("elm", document_id, F.lit("paragraph"), i).alias("id"),
            i.cast("int").alias("reading_order"),
            p["page"].cast("int").alias("page_number"),
            p["text"].alias("text"),
        ),
    )


def elements_from_pages(df: DataFrame, pages: str = "pages", size: int = PAGE_ELEMENT_WORDS) -> DataFrame:
    """Rows (document_id, pages array<string>) to paragraph elements; empty documents give none."""
    exploded = df.select(
        "document_id", F.explode(page_elements(F.col(pages), F.col("document_id"), size)).alias("e")
    )
    return exploded.select(
        "document_id", "e.id", F.lit("paragraph").alias("kind"), "e.reading_order", "e.text",
        locator(
            kind=F.lit("pdf"), page_number=F.col("e.page_number"),
            x0=F.lit(0.0), y0=F.lit(0.0), x1=F.lit(1.0), y1=F.lit(1.0),
        ).alias("locator"),
    )


def page_rejects(df: DataFrame, pages: str = "pages") -> DataFrame:
    return df.filter(~F.exists(F.col(pages), lambda p: F.size(words(p)) > 0)).select(
        F.lit("document").alias("entity"), F.col("document_id").alias("id"),
        F.lit("extractable_text").alias("rule"), F.lit("RESULT_INVALID").alias("code"),
    )


def parse_exchange(df: DataFrame, content: str = "content") -> DataFrame:
    return df.select("document_id", F.from_json(content, OCR_EXCHANGE).alias("x"))


def _exchange_valid(x: Column) -> Column:
    pages_ok = F.transform(x["pages"], lambda p: p["page_number"]) == F.transform(
        x["pages"], lambda p, i: i + 1
    )
    items_ok = F.forall(
        x["pages"],
        lambda p: (F.size(p["items"]) > 0)
        & (
            F.transform(p["items"], lambda t: t["order"]) == F.transform(p["items"], lambda t, i: i)
        )
        & F.forall(
            p["items"],
            lambda t: (F.length(t["text"]) > 0)
            & t["confidence"].between(0, 1)
            & t["layout"].isin("paragraph", "heading")
            & (F.size(t["bbox"]) == 4)
            & (F.array_min(t["bbox"]) >= 0)
            & (F.array_max(t["bbox"]) <= 1)
            & (t["bbox"][2] >= t["bbox"][0])
            & (t["bbox"][3] >= t["bbox"][1]),
        ),
    )
    return F.coalesce((F.size(x["pages"]) > 0) & pages_ok & items_ok, F.lit(False))


def elements_from_exchange(parsed: DataFrame) -> DataFrame:
    """Valid OCR exchanges to elements with a per-item confidence signal."""
    valid = parsed.filter(_exchange_valid(F.col("x")))
    # Pages in order, each with the number of items before it: one running sum over the page sizes.
    ordered = F.array_sort(F.col("x.pages"), lambda a, b: a["page_number"] - b["page_number"])
    sizes = F.transform(ordered, lambda q: F.size(q["items"]))
    before = F.aggregate(
        sizes, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.array_append(acc["starts"], acc["sum"]).alias("starts")),
    )["starts"]
    pages = valid.select("document_id", F.explode(F.arrays_zip(ordered.alias("p"), before.alias("_before"))).alias("z"))
    items = pages.select(
        "document_id", F.col("z.p.page_number").alias("page_number"), F.col("z._before").alias("_before"),
        F.posexplode("z.p.items").alias("_pos", "t")
    )
    heading = F.col("t.layout") == "heading"
    order = (F.col("_before") + F.col("_pos")).cast("int")
    return items.select(
        "document_id",
        stable_id("elm", F.col("document_id"), F.when(heading, F.lit("heading")).otherwise(F.lit("paragraph")), order).alias("id"),
        F.when(heading, F.lit("heading")).otherwise(F.lit("paragraph")).alias("kind"),
        order.alias("reading_order"),
        F.when(heading, F.lit(1)).alias("level"),
        F.col("t.text").alias("text"),
        F.col("t.language").alias("language"),
        F.col("t.confidence").alias("confidence"),
        F.when(F.col("t.confidence") >= 0.8, F.lit("PASS")).otherwise(F.lit("WARN")).alias("signal"),
        locator(
            kind=F.lit("pdf"), page_number=F.col("page_number"),
            x0=F.col("t.bbox")[0], y0=F.col("t.bbox")[1], x1=F.col("t.bbox")[2], y1=F.col("t.bbox")[3],
        ).alias("locator"),
    )


def exchange_summary(elements: DataFrame) -> DataFrame:
    """Per document: element count and the confidence bucket of the mean."""
    mean = F.round(F.avg("confidence"), 9)
    return elements.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.when(mean >= 0.9, "high").when(mean >= 0.8, "medium").otherwise("low").alias("bucket"),
    )


def exchange_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~_exchange_valid(F.col("x"))).select(
        F.lit("document").alias("entity"), F.col("document_id").alias("id"),
        F.lit("exchange").alias("rule"), F.lit("RESULT_INVALID").alias("code"),
    )


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents (one JSON object per file) with the fixed schema; other versions fail."""
    raw = (
        spark.read.schema(CANONICAL).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    )
    version = F.col("schema_version")
    bad = F.raise_error(F.concat(F.lit("unknown schema_version: "), F.coalesce(version, F.lit("none"))))
    return raw.withColumn(
        "schema_version", F.when(version.isin("v1", CANONICAL_VERSION), version).otherwise(bad.cast("string"))
    )


def canonical_elements(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.col("metadata.language").alias("document_language"), F.inline("elements"))


def canonical_tables(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.inline("tables"))


def normalize_provider(elements: DataFrame, tables: DataFrame | None = None, cells: DataFrame | None = None):
    """Give typed provider rows their identities.

    `elements` needs (source_digest, kind, reading_order, parent_reading_order, locator, ...),
    `tables` (source_digest, element_reading_order, caption_reading_order, related_reading_orders,
    header_cell_positions, rows, columns, locator) and `cells` (source_digest,
    element_reading_order, row, column, ...). Ids follow from digest and position, so references by
    reading order resolve by one equi-join on (source, reading order).
    """
    source = F.col("source_digest")
    ids = elements.withColumn(
        "id",
        stable_id("elm", source, F.lit(CANONICAL_VERSION), F.col("kind"), F.col("reading_order"), locator_key("locator")),
    ).withColumn("document_id", stable_id("doc", source, F.lit(CANONICAL_VERSION))).withColumn(
        "table_id", F.when(F.col("kind") == "table", stable_id("tbl", source, F.col("reading_order")))
    )
    keys = ids.select("source_digest", F.col("reading_order").alias("_order"), F.col("id").alias("_id"))
    parents = keys.withColumnsRenamed({"_order": "parent_reading_order", "_id": "parent_id"})
    out_elements = ids.join(parents, ["source_digest", "parent_reading_order"], "left")
    if tables is None:
        return out_elements, None, None
    element_keys = keys.withColumnsRenamed({"_order": "element_reading_order", "_id": "element_id"})
    caption_keys = keys.withColumnsRenamed({"_order": "caption_reading_order", "_id": "caption_element_id"})
    linked = (
        tables.select(
            "source_digest", "element_reading_order",
            F.posexplode("related_reading_orders").alias("_pos", "_order"),
        )
        .join(keys, ["source_digest", "_order"])
        .groupBy("source_digest", "element_reading_order")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda x: x["_id"]
            ).alias("related_element_ids")
        )
    )

    def cell_id(row: Column, column: Column) -> Column:
        return stable_id("cel", source, F.col("element_reading_order"), row, column)

    out_tables = (
        tables.withColumn("id", stable_id("tbl", source, F.col("element_reading_order")))
        .withColumn("document_id", stable_id("doc", source, F.lit(CANONICAL_VERSION)))
        .withColumn(
            "header_cell_ids",
            F.transform("header_cell_positions", lambda p: cell_id(p["row"], p["column"])),
        )
        .join(element_keys, ["source_digest", "element_reading_order"])
        .join(caption_keys, ["source_digest", "caption_reading_order"], "left")
        .join(linked, ["source_digest", "element_reading_order"], "left")
    )
    out_cells = None
    if cells is not None:
        out_cells = (
            cells.withColumn("id", cell_id(F.col("row"), F.col("column")))
            .withColumn("table_id", stable_id("tbl", source, F.col("element_reading_order")))
            .withColumn("document_id", stable_id("doc", source, F.lit(CANONICAL_VERSION)))
        )
    return out_elements, out_tables, out_cells

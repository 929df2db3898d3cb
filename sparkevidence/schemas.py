"""Spark types of the tables exchanged between operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fields are alphabetical so that to_json gives one comparable key (see ids.locator_key).
LOCATOR = T.StructType(
    [
        T.StructField("anchor", T.StringType()),
        T.StructField("heading_anchor", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("paragraph_index", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("range", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("slide_number", T.IntegerType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
    ]
)
LIST_ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])
ELEMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("items", T.ArrayType(LIST_ITEM)),
        T.StructField("alt_text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("locator", LOCATOR),
    ]
)
CELL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("row_span", T.IntegerType()),
        T.StructField("column_span", T.IntegerType()),
        T.StructField("is_header", T.BooleanType()),
    ]
)
TABLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("element_id", T.StringType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("columns", T.IntegerType()),
        T.StructField("locator", LOCATOR),
        T.StructField("cells", T.ArrayType(CELL)),
        T.StructField("header_cell_ids", T.ArrayType(T.StringType())),
        T.StructField("caption_element_id", T.StringType()),
        T.StructField("related_element_ids", T.ArrayType(T.StringType())),
    ]
)
CANONICAL = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType([T.StructField(n, T.StringType()) for n in ("media_type", "title", "language")]),
        ),
        T.StructField(
            "provenance",
            T.StructType(
                [
                    T.StructField(n, T.StringType())
                    for n in ("adapter_id", "source_artifact_id", "source_content_digest")
                ]
            ),
        ),
        T.StructField("elements", T.ArrayType(ELEMENT)),
        T.StructField("tables", T.ArrayType(TABLE)),
    ]
)
OCR_EXCHANGE = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page_number", T.IntegerType()),
                        T.StructField(
                            "items",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("order", T.IntegerType()),
                                        T.StructField("text", T.StringType()),
                                        T.StructField("language", T.StringType()),
                                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                                        T.StructField("confidence", T.DoubleType()),
                                        T.StructField("layout", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
ENRICHMENT = "struct<value string, value_type string, producer string, config_digest string, source_chunk_id string>"
SLICES = (
    "format", "processing_class", "native_ocr", "structure",
    "language", "question_class", "difficulty", "criticality",
)


def locator(**fields: Column) -> Column:
    """A locator struct with every field of the union, the given ones filled."""
    unknown = set(fields) - set(LOCATOR.fieldNames())
    if unknown:
        raise ValueError(f"unknown locator fields: {sorted(unknown)}")
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOCATOR.fields
        ]
    )

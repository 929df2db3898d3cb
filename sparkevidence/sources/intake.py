"""Content intake, deduplication and digest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as (document_id, name, content) rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content"
    )


def _extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


# Media types of the accepted extensions.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "json": "application/json",
    "html": "text/html",
    "txt": "text/plain",
}


def describe(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Describe each source, empty or lost ones too; the digest is its address."""
    body = F.col(content).cast("binary")
    extension = _extension(F.col(name))
    media = F.lit("application/octet-stream")
    for ext, media_type in MEDIA_TYPES.items():
        media = F.when(extension == ext, F.lit(media_type)).otherwise(media)
    size = F.octet_length(body)
    return df.select(
        "document_id",
        F.sha2(body, 256).alias("content_digest"),
        size.cast("long").alias("byte_size"),
        extension.alias("extension"),
        media.alias("media_type"),
        (F.substring(body, 1, 5) == F.lit(b"%PDF-")).alias("has_embedded_text"),
    )


def intake(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Describe each non-empty source, whatever its size."""
    return describe(df, name, content).filter(F.col("byte_size") > 0)


def intake_rejects(df: DataFrame, content: str = "content") -> DataFrame:
    size = F.octet_length(F.col(content).cast("binary"))
    return df.filter(size.isNull() | (size == 0)).select(
        F.lit("source").alias("entity"),
        F.col("document_id").cast("string").alias("id"),
        F.lit("content_size").alias("rule"),
        F.lit("SOURCE_INVALID").alias("code"),
    )


def dedupe_sources(df: DataFrame, arrival: str = "document_id") -> DataFrame:
    """One row per content; the earliest arrival wins. Hash aggregation combines copies map-side."""
    rest = [c for c in df.columns if c not in ("content_digest", "byte_size")]
    first = df.groupBy("content_digest", "byte_size").agg(
        F.min_by(F.struct(*rest), F.col(arrival)).alias("_first"), F.count(F.lit(1)).alias("copies")
    )
    return first.select("content_digest", "byte_size", "_first.*", "copies")


def verify_digests(stored: DataFrame, content: str = "content") -> DataFrame:
    """Rejects: stored digest or size that differs from the recomputed one."""
    body = F.col(content).cast("binary")
    wrong_digest = F.sha2(body, 256) != F.col("content_digest")
    wrong_size = F.octet_length(body) != F.col("byte_size")
    return stored.filter(wrong_digest | wrong_size).select(
        F.lit("source").alias("entity"),
        F.col("document_id").cast("string").alias("id"),
        F.when(wrong_digest, F.lit("digest")).otherwise(F.lit("size")).alias("rule"),
        F.lit("CONTENT_MISMATCH").alias("code"),
    )

"""Text, Markdown and PDF files as segments; checks of uploads."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import file_name, strip, suffix

KINDS = {".pdf": "pdf", ".txt": "txt", ".md": "md"}


def reject_reason(path: Column, size: Column, settings: Settings = DEFAULTS) -> Column:
    """Null if a file may be uploaded; a file of exactly the largest size may."""
    return F.when(~suffix(path).isin(*settings.extensions), "unsupported").when(size > settings.max_file_size, "too_large")


def file_kind(path: Column) -> Column:
    """pdf, txt or md by suffix; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), suffix(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each text or Markdown file as one segment without a page."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    kind = file_kind(F.col("path"))
    return rows.where(kind.isin("txt", "md")).select(
        F.md5("path").alias("document_id"), F.lit(0).alias("index"), F.col("value").alias("content"), F.lit(None).cast("int").alias("page_number"),
        file_name(F.col("path")).alias("source"), F.lit(None).cast("int").alias("total_pages"), kind.alias("file_type"),
    )


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Each page with text as a segment; pages keep their numbers. Needs the optional ``pypdf``."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                found = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"path": name, "page_number": range(1, len(found) + 1), "text": found, "total_pages": len(found)})

    files = spark.read.format("binaryFile").load(path).select("path", "content").where(file_kind(F.col("path")) == "pdf")
    rows = files.mapInPandas(pages, "path string, page_number int, text string, total_pages int").where(F.length(strip(F.col("text"))) > 0)
    return rows.select(
        F.md5("path").alias("document_id"), (F.col("page_number") - 1).alias("index"), F.col("text").alias("content"), "page_number",
        file_name(F.col("path")).alias("source"), "total_pages", F.lit("pdf").alias("file_type"),
    )


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, failed) of already read files (document_id, path, text): one segment each, or why there is none."""
    kind = file_kind(F.col("path"))
    good = files.where(kind.isNotNull()).select(
        F.col("document_id").cast("string").alias("document_id"), F.lit(0).alias("index"), F.col("text").alias("content"), F.lit(None).cast("int").alias("page_number"),
        file_name(F.col("path")).alias("source"), F.lit(None).cast("int").alias("total_pages"), kind.alias("file_type"),
    )
    failed = files.where(kind.isNull()).select(F.col("document_id").cast("string").alias("document_id"), "path", F.concat(F.lit("unsupported file type: "), suffix(F.col("path"))).alias("error"))
    return good, failed


"""Cutting segments into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.config import DEFAULTS
from lectern.functions.text import strip


def window_starts(text: Column, size: int, step: int) -> Column:
    """0-based starts of windows; the first window that reaches the end is the last."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def fixed(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Add chunk_index, content, start_char, end_char: windows of ``size`` that overlap; a step of 0 or less overlaps by nothing."""
    step = size - overlap if size > overlap else size
    rows = docs.select("*", F.posexplode(window_starts(F.col(text), size, step)).alias("chunk_index", "start_char")) if size > 0 else docs.select("*", F.lit(0).alias("chunk_index"), F.lit(0).alias("start_char")).limit(0)
    return rows.withColumn("content", F.substr(text, F.col("start_char") + 1, F.lit(size))).withColumn("end_char", F.least(F.col("start_char") + size, F.length(text)))


def delimited(docs: DataFrame, delimiter: str, text: str = "text") -> DataFrame:
    """Add chunk_index, content: parts between a literal delimiter, trimmed, blanks dropped, the delimiter before all but an unprefixed first part."""
    if not delimiter:
        return docs.where(F.length(text) > 0).select("*", F.lit(0).alias("chunk_index"), F.col(text).alias("content"))
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.transform(F.split(text, quoted, -1), lambda part, i: F.struct(i.alias("i"), strip(part).alias("part")))
    prefixed = F.transform(
        F.filter(parts, lambda p: F.length(p["part"]) > 0),
        lambda p: F.when(p["i"] > 0, F.concat(F.lit(delimiter), p["part"])).otherwise(p["part"]),
    )
    return docs.select("*", F.posexplode(prefixed).alias("chunk_index", "content"))


def paragraphs(docs: DataFrame, pattern: str = "\n\n+", text: str = "text") -> DataFrame:
    """Add chunk_index, content: parts between blank lines, empty ones dropped."""
    return docs.select("*", F.posexplode(F.filter(F.split(text, pattern, -1), lambda p: p != "")).alias("chunk_index", "content"))


def pages(segments: DataFrame) -> DataFrame:
    """One chunk per segment."""
    return segments.select("document_id", F.col("index").alias("chunk_index"), "content", "page_number", F.lit(0).alias("start_char"), F.length("content").alias("end_char"))


def joined(segments: DataFrame, separator: str = "\n") -> DataFrame:
    """document_id, text: a document's segments in order."""
    rows = segments.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("index", "content"))).alias("parts"))
    return rows.select("document_id", F.array_join(F.transform("parts", lambda p: p["content"]), separator).alias("text"))


def statistics(chunks: DataFrame, *keys: str) -> DataFrame:
    """Count, total, mean rounded half up, least and most characters; 0 where there are none."""
    size = F.length("content")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return chunks.groupBy(*keys).agg(
        F.count("content").alias("n_chunks"), zero(F.sum(size)).alias("total_chars"), zero(F.floor(F.avg(size) + 0.5)).alias("mean_chars"),
        zero(F.min(size)).alias("min_chars"), zero(F.max(size)).alias("max_chars"),
    )


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = DEFAULTS.separators) -> list[str]:
    """The pieces of ``split_spans``."""
    return [piece for _, piece in split_spans(text, size, overlap, separators)]


def split_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = DEFAULTS.separators, start: int = 0) -> list[tuple[int, str]]:
    """(where it starts, piece) for pieces of at most ``size`` where the separators allow, cut at the most wanted separator that occurs.

    A separator stays at the start of the piece behind it. Small pieces are put together, with up
    to ``overlap`` characters carried over; pieces that are too large are cut by the separators that are left.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        return _stripped(start, text)
    separator, rest = separators[at], separators[at + 1 :]
    if separator == "":
        pieces = list(text)
    else:
        first, *others = text.split(separator)
        pieces = [p for p in (first, *(separator + o for o in others)) if p]
    found: list[tuple[int, str]] = []
    small: list[str] = []
    begin = end = start
    for piece in pieces:
        end += len(piece)
        if len(piece) < size or (separator == "" and size > 0):
            small.append(piece)
            continue
        found += _put_together(small, size, overlap, begin)
        small, begin = [], end
        found += split_spans(piece, size, overlap, rest, end - len(piece)) if rest else [(end - len(piece), piece)]
    return found + _put_together(small, size, overlap, begin)


def _stripped(start: int, text: str) -> list[tuple[int, str]]:
    left = text.lstrip()
    return [(start + len(text) - len(left), left.rstrip())] if left else []


def _put_together(pieces: list[str], size: int, overlap: int, start: int) -> list[tuple[int, str]]:
    found, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            found += _stripped(start, "".join(window))
            drop = 0
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(window[drop])
                start += len(window[drop])
                drop += 1
            window = window[drop:]
        window.append(piece)
        total += len(piece)
    return found + _stripped(start, "".join(window))


def recursive(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = DEFAULTS.separators, text: str = "text") -> DataFrame:
    """Add chunk_index, content: the recursive splitter; its depth depends on the text, so it runs in Python by Arrow batches."""
    return recursive_spans(docs, size, overlap, separators, text).drop("start_char")


def recursive_spans(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = DEFAULTS.separators, text: str = "text") -> DataFrame:
    """The same with start_char, where in the text each chunk starts."""

    @pandas_udf("array<struct<start_char:int,content:string>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start_char": at, "content": piece} for at, piece in split_spans(t, size, overlap, separators)] if t else [])

    return docs.select("*", F.posexplode(split(text)).alias("chunk_index", "_piece")).select(*docs.columns, "chunk_index", "_piece.*")


def for_submission(chunks: DataFrame, page: Column | None = None) -> DataFrame:
    """document_id, chunk_index, content, page_number, start_char, end_char, metadata as a manual upload sends them."""
    return chunks.select(
        "document_id", "chunk_index", "content", (page if page is not None else F.lit(None)).cast("int").alias("page_number"), F.lit(0).alias("start_char"),
        F.length("content").alias("end_char"), F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")).alias("metadata"),
    )

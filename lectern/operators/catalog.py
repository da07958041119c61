"""Catalog tables: changes as logs and tombstones, latest views, lists and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import ellipsis, merged

#: Progress and stage of each step of ingest.
STAGES = {"pending": (0, None), "parsing": (0, "parsing"), "chunking": (33, "chunking"), "embedding": (66, "embedding"), "completed": (100, "completed"), "failed": (0, "failed")}


#: Characters of a vector entity's content, source and file type.
LIMITS = {"content": 65535, "source": 500, "file_type": 20}


def vector_entities(chunks: DataFrame) -> DataFrame:
    """id ``{document_id}_{chunk_index}`` and the chunk's columns, cut to the store's lengths."""
    cut = [F.substring(c, 1, n).alias(c) for c, n in LIMITS.items()]
    return chunks.select(F.concat_ws("_", "document_id", "chunk_index").alias("id"), "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), *cut)


def new_documents(files: DataFrame) -> DataFrame:
    """Catalog rows of new files (document_id, path, size): pending, nothing processed."""
    return files.select(
        F.col("document_id").alias("id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.ltrim(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)), F.lit(".")).alias("file_type"),
        F.col("size").alias("file_size"), F.col("path").alias("file_path"), F.lit("pending").alias("status"), F.lit(0).alias("processing_progress"), F.lit(0).alias("chunk_count"), F.lit(0).cast("bigint").alias("total_characters"),
    )


def manual_documents(requests: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, rejected) of documents that come cut already.

    ``requests``: document_id, filename, file_type, file_size. ``chunks``: document_id, chunk_index, content, page_number,
    start_char, end_char, metadata. A chunk's own metadata go over the defaults of its document. A request
    without chunks, or of a type that is not allowed, is rejected with the reason.
    """
    sizes = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("total_characters"))
    kind = F.lower("file_type")
    reason = F.when(F.col("chunk_count").isNull(), "Chunks cannot be empty").when(
        ~F.coalesce(F.concat(F.lit("."), kind).isin(*settings.extensions), F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce("file_type", F.lit("")))
    )
    rows = requests.join(sizes, "document_id", "left").withColumn("reason", reason).withColumn("file_type", kind)
    progress, stage = STAGES["completed"]
    good = rows.where("reason is null")
    documents = good.select(
        F.col("document_id").alias("id"), "filename", "file_type", "file_size", F.concat(F.lit("manual://"), F.col("document_id").cast("string")).alias("file_path"), F.lit("completed").alias("status"),
        F.lit(progress).alias("processing_progress"), F.lit(stage).alias("current_stage"), "chunk_count", "total_characters",
    )
    defaults = {
        "source": F.col("filename"), "file_type": F.col("file_type"), "page": F.col("page_number").cast("string"), "document_id": F.col("document_id").cast("string"), "chunk_index": F.col("chunk_index").cast("string"),
    }
    base = F.create_map(*[c for name, value in defaults.items() for c in (F.lit(name), value)])
    cut = chunks.join(good.select("document_id", "filename", "file_type"), "document_id").withColumn("metadata", merged(base, F.col("metadata")))
    cut = cut.select("document_id", "chunk_index", "content", "page_number", "start_char", "end_char", "metadata", F.concat_ws("_", "document_id", "chunk_index").alias("vector_id"))
    return documents, cut, rows.where("reason is not null").select("document_id", "filename", "reason")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key of a status log; one aggregation, no sort."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_last")).select(key, "_last.*")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted ones: documents, their chunks, vectors and index rows alike."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows, and ``total``, the number of all of them."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(skip).limit(limit).join(F.broadcast(total))  # one row


def list_documents(documents: DataFrame, status: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    if status and status != "all":
        documents = documents.where(F.col("status") == status)
    return page(documents, [F.col("created_at").desc(), F.col("id")], skip, limit)


def with_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its chunks, in order, as an array."""
    packed = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    return documents.join(packed, documents["id"] == packed["document_id"], "left").drop("document_id")


def conversations(messages: DataFrame, preview: int = 100) -> DataFrame:
    """conv_id, message_count, last_turn, last_message: derived from the messages in one aggregation."""
    found = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("text"))
    return found.select("conv_id", "message_count", "last_turn", ellipsis(F.col("text"), preview).alias("last_message"))


def search_conversations(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose title or last message has the text, whatever the case; ``%`` and ``_`` are ordinary."""
    wanted = F.lower(F.lit(text))
    return rows.where(F.coalesce(F.contains(F.lower("title"), wanted), F.lit(False)) | F.coalesce(F.contains(F.lower("last_message"), wanted), F.lit(False)))


def by_category(providers: DataFrame) -> DataFrame:
    return providers.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_configured").alias("n_configured"))


def toggled(selected: Column, item: Column) -> Column:
    """The selection without the item if it has it, else with it at the end."""
    return F.when(F.array_contains(selected, item), F.array_remove(selected, item)).otherwise(F.array_append(selected, item))


def patched(rows: DataFrame, key: str, value, changes: dict[str, Column]) -> DataFrame:
    """Changed columns in the rows of one key."""
    return rows.withColumns({c: F.when(F.col(key) == F.lit(value), new).otherwise(F.col(c)) for c, new in changes.items()})


def rank_in_pages(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n)
